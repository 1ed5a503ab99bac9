"""Identity graph as an edge table: multi-hop resolution, typed walks, batches.

Every traversal runs for all requested roots at once, one join per hop.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.schema import ENTITY_RELATIONSHIPS, conform
from wayline.session import materialize

_EDGE_KEYS = ["to_entity_type", "to_entity", "relationship_type", "source", "confidence_score"]


def entity_key(entity_type: Column | str, entity_id: Column | str) -> Column:
    """``type:id``."""
    return F.concat_ws(":", entity_type, entity_id)


def split_key(key: Column | str) -> tuple[Column, Column]:
    """Type and id of a ``type:id`` key; the id may hold further colons."""
    parts = F.split(key, ":", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def ordered_edges(edges: DataFrame) -> DataFrame:
    """Edges with ``edge_ord``, their order within a from-node.

    Pass a column of that name to fix the order; without it edges count in the
    order they were detected, then by their other columns.
    """
    if "edge_ord" in edges.columns:
        return edges
    keys = [c for c in ["detected_at", *_EDGE_KEYS] if c in edges.columns]
    return edges.withColumn("edge_ord", F.struct(*keys))


def _live(edges: DataFrame, as_of: datetime | Column | None) -> DataFrame:
    if as_of is None:
        return edges
    return edges.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of)))


def _steps(edges: DataFrame) -> DataFrame:
    return ordered_edges(edges).select(
        F.col("from_entity_type").alias("__from_type"),
        F.col("from_entity").alias("__from_id"),
        F.col("to_entity_type").alias("__to_type"),
        F.col("to_entity").alias("__to_id"),
        F.col("confidence_score").cast("double").alias("__edge_conf"),
        F.col("edge_ord").alias("__ord"),
    )


def resolve(
    roots: DataFrame,
    edges: DataFrame,
    *,
    target_type: str | None = None,
    min_confidence: float = 0.5,
    max_depth: int = 3,
    as_of: datetime | Column | None = None,
    policy: str = "first",
) -> DataFrame:
    """Everything reachable from each root ``(entity_type, entity_id)``.

    The confidence of a path is the product of its edges and may never fall
    below ``min_confidence``.  A node counts once per root, by the path a
    breadth-first queue would reach it on first: fewest hops, then the edge
    order along the path (``policy="best"``: fewest hops, then the strongest
    path).  The root itself is never a result, and ``target_type`` limits the
    results, not the traversal.

    The breadth-first order of a node is the list of edge positions on its
    path, compared from the front.  Carrying that list needs no ranking per
    root, so a root with a very large neighbourhood stays spread out.  What a
    hop reaches is written to the shared folder: the work grows with the depth
    instead of doubling per hop, and a lost executor costs one hop at most.
    """
    if policy not in ("first", "best"):
        raise ValueError(f"Unknown policy: {policy}")
    steps = _steps(_live(edges, as_of))
    ord_type = steps.schema["__ord"].dataType.simpleString()
    node = ["root_type", "root_id", "node_type", "node_id"]
    reached = (
        roots.select(F.col("entity_type").alias("root_type"), F.col("entity_id").alias("root_id"))
        .distinct()
        .select(
            "root_type",
            "root_id",
            F.col("root_type").alias("node_type"),
            F.col("root_id").alias("node_id"),
            F.struct(
                F.lit(0).alias("depth"),
                F.lit(-1.0).alias("strength"),
                F.array().cast(f"array<{ord_type}>").alias("ords"),
                F.lit(1.0).alias("conf"),
                F.array(entity_key("root_type", "root_id")).alias("path"),
            ).alias("best"),
        )
    )
    # with "first" the strength takes no part in the order
    for depth in range(1, max_depth + 1):
        frontier = reached.where(F.col("best.depth") == depth - 1)
        conf = F.col("best.conf") * F.col("__edge_conf")
        step = (
            frontier.join(
                steps,
                (F.col("node_type") == F.col("__from_type")) & (F.col("node_id") == F.col("__from_id")),
            )
            .where(conf >= F.lit(min_confidence))
            .select(
                "root_type",
                "root_id",
                F.col("__to_type").alias("node_type"),
                F.col("__to_id").alias("node_id"),
                F.struct(
                    F.lit(depth).alias("depth"),
                    (-conf if policy == "best" else F.lit(-1.0)).alias("strength"),
                    F.concat("best.ords", F.array("__ord")).alias("ords"),
                    conf.alias("conf"),
                    F.concat("best.path", F.array(entity_key("__to_type", "__to_id"))).alias("path"),
                ).alias("best"),
            )
        )
        # one aggregation drops nodes seen at a lower depth and picks the path
        reached = reached.unionByName(step).groupBy(*node).agg(F.min("best").alias("best"))
        if depth < max_depth:
            # the next hop reads it twice: as its start and as what is known
            reached = materialize(reached, "reached")
    found = reached.where(F.col("best.depth") > 0)
    if target_type is not None:
        found = found.where(F.col("node_type") == target_type)
    return found.select(
        "root_type",
        "root_id",
        F.col("node_id").alias("entity_id"),
        F.col("node_type").alias("entity_type"),
        F.round("best.conf", 4).alias("confidence"),
        F.lit("graph_walk").alias("source"),
        F.col("best.depth").alias("depth"),
        F.col("best.path").alias("path"),
        F.col("best.ords").alias("walk_order"),
    )


def walk(roots: DataFrame, edges: DataFrame, path_types: list[str]) -> DataFrame:
    """All paths from each root through exactly these entity types.

    The first type stands for the root and is not checked.  Roots without
    outgoing edges and an empty list give nothing; parallel edges give one path
    each.
    """
    steps = _steps(edges)
    current = roots.select(
        F.col("entity_type").alias("root_type"),
        F.col("entity_id").alias("root_id"),
        F.col("entity_type").alias("node_type"),
        F.col("entity_id").alias("node_id"),
        F.lit(1.0).alias("conf"),
        F.array(entity_key("entity_type", "entity_id")).alias("path"),
    )
    if not path_types:
        current = current.where(F.lit(False))
    if len(path_types) <= 1:
        sources = steps.select("__from_type", "__from_id")
        current = current.join(
            sources,
            (F.col("node_type") == F.col("__from_type")) & (F.col("node_id") == F.col("__from_id")),
            "left_semi",
        )
    for next_type in path_types[1:]:
        current = current.join(
            steps.where(F.col("__to_type") == next_type),
            (F.col("node_type") == F.col("__from_type")) & (F.col("node_id") == F.col("__from_id")),
        ).select(
            "root_type",
            "root_id",
            F.col("__to_type").alias("node_type"),
            F.col("__to_id").alias("node_id"),
            (F.col("conf") * F.col("__edge_conf")).alias("conf"),
            F.concat("path", F.array(entity_key("__to_type", "__to_id"))).alias("path"),
        )
    return current.select(
        "root_type",
        "root_id",
        F.col("node_id").alias("entity_id"),
        F.col("node_type").alias("entity_type"),
        F.round("conf", 4).alias("confidence"),
        F.lit("path_walk").alias("source"),
        "path",
    )


def graph_stats(edges: DataFrame) -> DataFrame:
    """Number of nodes with outgoing edges, and of edges."""
    per_node = edges.groupBy("from_entity_type", "from_entity").agg(F.count(F.lit(1)).alias("n"))
    return per_node.agg(
        F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("relationships")
    )


def resolve_batch(entities: DataFrame, resolvers: list[DataFrame]) -> DataFrame:
    """First resolver that knows an entity wins; unknown entities are left out.

    A resolver is a mapping table ``(entity_type, entity_id, to_entity, to_type,
    relationship_type, confidence, source, extra)``; the list order is the
    priority.  A repeated input entity gives a repeated row.
    """
    columns = ["to_entity", "to_type", "relationship_type", "confidence", "source"]
    ranked = None
    for priority, mapping in enumerate(resolvers):
        extra = F.to_json("extra") if "extra" in mapping.columns else F.lit(None).cast("string")
        rows = mapping.select(
            "entity_type",
            "entity_id",
            F.struct(
                F.lit(priority).alias("priority"),
                *[F.col(c) for c in columns],
                extra.alias("extra"),
            ).alias("__hit"),
        )
        ranked = rows if ranked is None else ranked.unionByName(rows)
    best = ranked.groupBy("entity_type", "entity_id").agg(F.min("__hit").alias("__hit"))
    return entities.join(best, ["entity_type", "entity_id"]).select(
        F.col("entity_id").alias("from_entity"),
        F.col("entity_type").alias("from_entity_type"),
        F.col("__hit.to_entity").alias("to_entity"),
        F.col("__hit.to_type").alias("to_entity_type"),
        F.col("__hit.relationship_type").alias("relationship_type"),
        F.col("__hit.confidence").alias("confidence_score"),
        F.col("__hit.source").alias("source"),
        F.col("__hit.extra").alias("extra"),
    )


def resolve_wallets(wallets: DataFrame, resolvers: list[DataFrame], column: str = "address") -> DataFrame:
    """``resolve_batch`` for a table of wallet addresses."""
    entities = wallets.select(F.lit("wallet").alias("entity_type"), F.col(column).alias("entity_id"))
    return resolve_batch(entities, resolvers)


def name_mapping(landed: DataFrame) -> DataFrame:
    """Landed name lookups ``(address, name, avatar)`` as a resolver table."""
    return landed.where(F.col("name") != "").select(
        F.lit("wallet").alias("entity_type"),
        F.col("address").alias("entity_id"),
        F.col("name").alias("to_entity"),
        F.lit("ens").alias("to_type"),
        F.lit("resolved_to").alias("relationship_type"),
        F.lit(0.95).alias("confidence"),
        F.lit("ens").alias("source"),
        F.create_map(F.lit("avatar"), F.col("avatar")).alias("extra"),
    )


def relationship_rows(resolved: DataFrame, detected_at: datetime | Column | None = None) -> DataFrame:
    """Rows of the relationship table; they never expire and carry no extra."""
    when = F.current_timestamp() if detected_at is None else F.lit(detected_at)
    return conform(
        resolved.withColumns({"detected_at": when, "expires_at": F.lit(None)}), ENTITY_RELATIONSHIPS
    )


def _reach(steps: DataFrame, target_type: str, hops: int, min_confidence: float) -> list[DataFrame]:
    """For 1, 2 … hops: the nodes ``(__id_type, __id)`` from which some path of so many edges at most
    ends at the type with a confidence that alone is high enough.

    Labels run backwards from the targets, one number a node, whatever the roots are.
    """
    min_confidence *= 1 - 1e-9  # products of doubles depend on their order a little
    into = F.when(F.col("__to_type") == target_type, F.col("__edge_conf"))
    first = F.max(into).alias("__best")
    reach = [steps.groupBy(F.col("__from_type").alias("__id_type"), F.col("__from_id").alias("__id")).agg(first).where(F.col("__best") >= min_confidence)]
    while len(reach) < hops:
        last = reach[-1]
        further = steps.join(last, (F.col("__to_type") == F.col("__id_type")) & (F.col("__to_id") == F.col("__id")))
        further = further.select(
            F.col("__from_type").alias("__id_type"), F.col("__from_id").alias("__id"), (F.col("__edge_conf") * F.col("__best")).alias("__best")
        )
        known = last.unionByName(further).groupBy("__id_type", "__id").agg(F.max("__best").alias("__best"))
        reach.append(materialize(known.where(F.col("__best") >= min_confidence), "reach"))
    return reach


def wallets_of(roots: DataFrame, edges: DataFrame, *, min_confidence: float = 0.5, max_depth: int = 3, wallet_type: str = "wallet") -> DataFrame:
    """The best wallet of each root: that of ``resolve`` with the highest rounded confidence, the first reached on a tie.

    The same search, but it keeps only what can still end at a wallet. A node from which no path of
    the hops that are left reaches one is dropped when it is met; were it met again, later, fewer
    hops would be left, so nothing that ``resolve`` finds is lost and nothing is found that it
    doesn't. The last hop goes to wallets only, and paths are not carried. Confidences are shares
    of one, so a path's is never above that of its last part.
    """
    steps = _steps(edges)
    ord_type = steps.schema["__ord"].dataType.simpleString()
    reach = _reach(steps, wallet_type, max_depth - 1, min_confidence) if max_depth > 1 else []
    node = ["root_type", "root_id", "node_type", "node_id"]
    best = F.struct(F.lit(0).alias("depth"), F.array().cast(f"array<{ord_type}>").alias("ords"), F.lit(1.0).alias("conf"))
    reached = (
        roots.select(F.col("entity_type").alias("root_type"), F.col("entity_id").alias("root_id"))
        .distinct()
        .select("root_type", "root_id", F.col("root_type").alias("node_type"), F.col("root_id").alias("node_id"), best.alias("best"))
    )
    is_wallet = F.col("__to_type") == wallet_type
    for depth in range(1, max_depth + 1):
        ahead = steps.where(is_wallet)
        if depth < max_depth:
            onward = reach[max_depth - depth - 1]
            on = (F.col("__to_type") == F.col("__id_type")) & (F.col("__to_id") == F.col("__id"))
            ahead = ahead.unionByName(steps.where(~F.coalesce(is_wallet, F.lit(False))).join(onward, on, "left_semi"))
        conf = F.col("best.conf") * F.col("__edge_conf")
        frontier = reached.where(F.col("best.depth") == depth - 1)
        step = frontier.join(ahead, (F.col("node_type") == F.col("__from_type")) & (F.col("node_id") == F.col("__from_id"))).where(conf >= F.lit(min_confidence))
        there = F.struct(F.lit(depth).alias("depth"), F.concat("best.ords", F.array("__ord")).alias("ords"), conf.alias("conf"))
        step = step.select("root_type", "root_id", F.col("__to_type").alias("node_type"), F.col("__to_id").alias("node_id"), there.alias("best"))
        reached = reached.unionByName(step).groupBy(*node).agg(F.min("best").alias("best"))
        if depth < max_depth:
            reached = materialize(reached, "reached")
    order = F.struct((-F.round("best.conf", 4)).alias("c"), F.col("best.depth").alias("depth"), F.col("best.ords").alias("ords"), "node_id")
    found = reached.where((F.col("best.depth") > 0) & (F.col("node_type") == wallet_type))
    return found.groupBy("root_type", "root_id").agg(F.min(order).alias("__best")).select("root_type", "root_id", F.col("__best.node_id").alias("wallet"))


def resolve_to_wallet(entities: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """The wallet each distinct ``(entity_type, entity_id)`` stands for.

    A wallet is itself.  Anything else is the most confident wallet the graph
    reaches in three hops, the first reached on a tie, or itself if none is.
    """
    distinct = entities.select("entity_type", "entity_id").distinct()
    if edges is None:
        return distinct.withColumn("wallet", F.col("entity_id"))
    others = distinct.where(F.col("entity_type") != "wallet")
    best = wallets_of(others, edges).select(
        F.col("root_type").alias("entity_type"), F.col("root_id").alias("entity_id"), F.col("wallet").alias("__wallet")
    )
    return distinct.join(best, ["entity_type", "entity_id"], "left").select(
        "entity_type", "entity_id", F.coalesce("__wallet", "entity_id").alias("wallet")
    )


def stitch_events(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Events re-keyed to the wallet of their entity, the old key kept beside.

    Events of an entity no wallet is known for keep their key.
    """
    mapping = resolve_to_wallet(events.select("entity_type", "entity_id"), edges).where(
        (F.col("wallet") != F.col("entity_id"))
    )
    mapping = mapping.select(
        F.col("entity_type").alias("__type"), F.col("entity_id").alias("__id"), F.col("wallet").alias("__wallet")
    )
    joined = events.join(
        mapping, (F.col("entity_type") == F.col("__type")) & (F.col("entity_id") == F.col("__id")), "left"
    )
    known = F.col("__wallet").isNotNull()
    return joined.select(
        F.coalesce("__wallet", "entity_id").alias("entity_id"),
        F.when(known, F.lit("wallet")).otherwise(F.col("entity_type")).alias("entity_type"),
        *[F.col(c) for c in events.columns if c not in ("entity_id", "entity_type")],
        F.col("entity_id").alias("original_entity_id"),
        F.col("entity_type").alias("original_entity_type"),
    )

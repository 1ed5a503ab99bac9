import random

import pytest
from pyspark.sql import functions as F

from wayline.operators import identity as G

EDGE = (
    "from_entity_type string, from_entity string, to_entity_type string, to_entity string, "
    "confidence_score double, edge_ord int"
)
ROOT = "entity_type string, entity_id string"


def breadth_first(edges, root, min_conf, max_depth):
    """Queue search over (from, to, confidence) in list order."""
    queue, seen, found = [(root, 1.0, [root])], set(), {}
    while queue:
        node, conf, path = queue.pop(0)
        if node in seen:
            continue
        seen.add(node)
        if len(path) > 1:
            found[node] = (conf, path)
        if len(path) <= max_depth:
            queue += [(to, conf * c, path + [to]) for frm, to, c in edges if frm == node and conf * c >= min_conf]
    return found


def test_resolution_equals_a_queue_search(spark):
    rng = random.Random(11)
    nodes = [(t, str(i)) for t in ("wallet", "ens") for i in range(6)]
    for trial in range(3):
        edges = [(rng.choice(nodes), rng.choice(nodes), rng.choice([0.5, 0.8, 0.9, 1.0])) for _ in range(40)]
        frame = spark.createDataFrame([(*a, *b, c, i) for i, (a, b, c) in enumerate(edges)], EDGE)
        roots = spark.createDataFrame(nodes + nodes[:2], ROOT)
        got = {}
        for r in G.resolve(roots, frame, min_confidence=0.4, max_depth=3).collect():
            got.setdefault((r.root_type, r.root_id), {})[(r.entity_type, r.entity_id)] = (r.confidence, r.path)
        for root in nodes:
            expected = breadth_first(edges, root, 0.4, 3)
            mine = got.get(root, {})
            assert {k: p for k, (_, p) in mine.items()} == {
                k: [":".join(n) for n in path] for k, (_, path) in expected.items()
            }
            assert all(abs(mine[k][0] - c) < 1e-4 for k, (c, _) in expected.items())


def test_first_path_wins_over_the_stronger_one(spark):
    edges = spark.createDataFrame(
        [("w", "a", "w", "b", 0.6, 0), ("w", "a", "w", "c", 1.0, 1), ("w", "b", "w", "d", 1.0, 0), ("w", "c", "w", "d", 1.0, 0),
         ("w", "d", "w", "a", 1.0, 0)],
        EDGE,
    )
    roots = spark.createDataFrame([("w", "a")], ROOT)
    first = {r.entity_id: r.confidence for r in G.resolve(roots, edges).collect()}
    best = {r.entity_id: r.confidence for r in G.resolve(roots, edges, policy="best").collect()}
    assert first == {"b": 0.6, "c": 1.0, "d": 0.6} and best["d"] == 1.0


def test_threshold_type_and_depth(spark):
    edges = spark.createDataFrame(
        [("wallet", "a", "ens", "b", 0.9, 0), ("ens", "b", "twitter", "c", 0.8, 0), ("twitter", "c", "email", "d", 1.0, 0)], EDGE
    )
    roots = spark.createDataFrame([("wallet", "a"), ("wallet", "alone")], ROOT)

    def ids(**options):
        return sorted((r.entity_id, r.confidence) for r in G.resolve(roots, edges, **options).collect())

    assert ids() == [("b", 0.9), ("c", 0.72), ("d", 0.72)]
    assert ids(min_confidence=0.8) == [("b", 0.9)]
    assert ids(target_type="twitter") == [("c", 0.72)]
    assert ids(max_depth=1) == [("b", 0.9)]
    assert ids(max_depth=6, min_confidence=0.1) == [("b", 0.9), ("c", 0.72), ("d", 0.72)]


def test_walk(spark):
    edges = spark.createDataFrame(
        [("wallet", "a", "ens", "b", 0.95, 0), ("wallet", "a", "ens", "b", 0.5, 1), ("wallet", "a", "wallet", "z", 0.9, 2),
         ("ens", "b", "twitter", "c", 0.8, 0)],
        EDGE,
    )
    roots = spark.createDataFrame([("wallet", "a"), ("wallet", "alone")], ROOT)

    def walk(types):
        return sorted((r.entity_id, r.confidence) for r in G.walk(roots, edges, types).collect())

    assert walk(["wallet", "ens", "twitter"]) == [("c", 0.4), ("c", 0.76)]
    assert walk(["ignored", "ens"]) == [("b", 0.5), ("b", 0.95)]
    assert walk(["wallet"]) == [("a", 1.0)]
    assert walk([]) == [] and walk(["wallet", "email"]) == []


def test_batch_takes_the_first_resolver(spark):
    schema = (
        "entity_type string, entity_id string, to_entity string, to_type string, relationship_type string, "
        "confidence double, source string, extra map<string,string>"
    )
    one = spark.createDataFrame([("wallet", "0xabc", "v.eth", "ens", "resolved_to", 0.95, "ens", {"avatar": "u"})], schema)
    two = spark.createDataFrame(
        [("wallet", "0xabc", "x", "ens", "resolved_to", 0.9, "static", None),
         ("wallet", "0xdef", "s.eth", "ens", "resolved_to", 0.9, "static", None)],
        schema,
    )
    wallets = spark.createDataFrame([("0xabc",), ("0xabc",), ("0xdef",), ("0x0",)], "address string")
    rows = sorted((r.from_entity, r.to_entity, r.extra or "") for r in G.resolve_wallets(wallets, [one, two]).collect())
    assert rows == [("0xabc", "v.eth", '{"avatar":"u"}')] * 2 + [("0xdef", "s.eth", "")]
    table = G.relationship_rows(G.resolve_wallets(wallets, [one, two])).collect()
    assert len(table) == 3 and all(r.expires_at is None and r.detected_at is not None for r in table)


def random_graph(spark, seed, n_edges=160):
    r = random.Random(seed)
    kinds = ["wallet", "device", "user", "hub"]
    node = lambda: (k := r.choice(kinds), f"{k[0]}{r.randint(0, 2 if k == 'hub' else 9)}")
    rows = []
    for i in range(n_edges):
        a, b = node(), node()
        rows.append((*a, *b, "linked", r.choice([0.3, 0.6, 0.7, 0.84, 0.9, 1.0]), i))
    names = "from_entity_type string, from_entity string, to_entity_type string, to_entity string, relationship_type string, confidence_score double, edge_ord int"
    edges = spark.createDataFrame(rows, names)
    roots = spark.createDataFrame([("user", f"u{i}") for i in range(10)] + [("device", f"d{i}") for i in range(10)], "entity_type string, entity_id string")
    return roots, edges


@pytest.mark.parametrize("seed,depth,least", [(1, 3, 0.5), (2, 3, 0.2), (3, 4, 0.3), (4, 2, 0.6), (5, 1, 0.5)])
def test_best_wallets_are_those_of_the_whole_search(spark, seed, depth, least):
    roots, edges = random_graph(spark, seed)
    whole = G.resolve(roots, edges, target_type="wallet", min_confidence=least, max_depth=depth)
    order = F.struct((-F.col("confidence")).alias("c"), "depth", "walk_order", "entity_id")
    want = whole.groupBy("root_type", "root_id").agg(F.min(order).alias("b")).select("root_type", "root_id", "b.entity_id")
    got = G.wallets_of(roots, edges, min_confidence=least, max_depth=depth)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_dead_ends_are_not_carried(spark, monkeypatch):
    """A hub of many devices without a wallet costs no row a root; one wallet behind it is found."""
    rows = [("user", f"u{i}", "hub", "h", "linked", 0.9, 0) for i in range(20)] + [("hub", "h", "device", f"d{i}", "linked", 0.9, i) for i in range(50)]
    rows += [("device", "d7", "wallet", "w", "linked", 0.9, 0)]
    names = "from_entity_type string, from_entity string, to_entity_type string, to_entity string, relationship_type string, confidence_score double, edge_ord int"
    written, materialize = {}, G.materialize

    def counted(df, label):
        out = materialize(df, label)
        written.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(G, "materialize", counted)
    roots = spark.createDataFrame([("user", f"u{i}") for i in range(20)], "entity_type string, entity_id string")
    got = G.wallets_of(roots, spark.createDataFrame(rows, names))
    assert sorted(r["wallet"] for r in got.collect()) == ["w"] * 20
    assert written["reached"] == [40, 60]  # roots, the hub for each, and the one device that leads on

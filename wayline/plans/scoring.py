"""Scoring wallets and selecting segments of them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayline.operators.asof import asof_join

# Points per signal when it is fully present; the sum is clipped to 100.
DEFAULT_WEIGHTS = {"volume": 40.0, "bridges": 25.0, "chains": 15.0, "swaps": 20.0}
# Level at which a signal is fully present.
DEFAULT_FULL = {"volume": 10_000.0, "bridges": 10.0, "chains": 4.0, "swaps": 20.0}
SIGNAL_SHARE = 0.5  # a signal is named once it reaches this share


def _top(events: DataFrame, column: str, n: int, result: str) -> DataFrame:
    """The n most frequent values per wallet, ranked on counts, not on events."""
    counts = events.where(F.col(column) != "").groupBy("entity_id", column).agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("entity_id").orderBy(F.desc("n"), column)
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .groupBy("entity_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", column))).alias("__top"))
        .select("entity_id", F.col(f"__top.{column}").alias(result))
    )


def wallet_features(events: DataFrame, bridge: str = "bridge_out", swap: str = "swap") -> DataFrame:
    """Per wallet: events, transfers, swaps, chains, USD volume."""
    per_chain = events.groupBy("entity_id", "chain").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("event_type") == bridge).alias("bridges"),
        F.count_if(F.col("event_type") == swap).alias("swaps"),
        F.sum(F.coalesce("amount_out_usd", "amount_in_usd")).alias("usd"),
    )
    return per_chain.groupBy("entity_id").agg(
        F.sum("n").alias("n_events"),
        F.sum("bridges").alias("bridges"),
        F.sum("swaps").alias("swaps"),
        F.count(F.nullif("chain", F.lit(""))).alias("chains"),
        F.coalesce(F.sum("usd"), F.lit(0)).cast("decimal(38,6)").alias("estimated_volume_usd"),
    )


def score_wallets(
    events: DataFrame,
    *,
    weights: dict[str, float] | None = None,
    full: dict[str, float] | None = None,
    bridge: str = "bridge_out",
    swap: str = "swap",
    top: int = 3,
) -> DataFrame:
    """Score 0-100, named signals, top chains and protocols and volume per wallet."""
    weights, full = weights or DEFAULT_WEIGHTS, full or DEFAULT_FULL
    features = wallet_features(events, bridge, swap)
    level = {"volume": "estimated_volume_usd", "bridges": "bridges", "chains": "chains", "swaps": "swaps"}

    def share(name: str) -> Column:
        return F.least(F.col(level[name]).cast("double") / F.lit(full[name]), F.lit(1.0))

    score = sum((share(name) * F.lit(weight) for name, weight in weights.items()), F.lit(0.0))
    named = F.array_compact(F.array(*[F.when(share(n) >= SIGNAL_SHARE, F.lit(n)) for n in weights]))
    empty = F.array().cast("array<string>")
    return (
        features.withColumns(
            {"score": F.round(F.greatest(F.least(score, F.lit(100.0)), F.lit(0.0)), 4), "signals": named}
        )
        .join(_top(events, "chain", top, "top_chains"), "entity_id", "left")
        .join(_top(events, "protocol", top, "top_protocols"), "entity_id", "left")
        .select(
            F.col("entity_id").alias("wallet_address"),
            "score",
            "signals",
            F.coalesce("top_chains", empty).alias("top_chains"),
            F.coalesce("top_protocols", empty).alias("top_protocols"),
            "estimated_volume_usd",
        )
    )


def segment(
    events: DataFrame,
    *,
    event_type: str = "bridge_out",
    chain: str | None = None,
    min_usd: float = 0.0,
    since: datetime | None = None,
    until: datetime | None = None,
    interacted: DataFrame | None = None,
    holders: DataFrame | None = None,
    **score_options,
) -> DataFrame:
    """Scored wallets with enough of an activity, highest score first.

    ``interacted(entity_id)`` excludes wallets, ``holders(entity_id)`` requires
    them.  The wallets are selected before anything is scored.
    """
    active = events.where(F.col("event_type") == event_type)
    if chain is not None:
        active = active.where(F.col("chain") == chain)
    if since is not None:
        active = active.where(F.col("timestamp") >= F.lit(since))
    if until is not None:
        active = active.where(F.col("timestamp") <= F.lit(until))
    wallets = (
        active.groupBy("entity_id")
        .agg(F.sum("amount_out_usd").alias("__usd"))
        .where(F.col("__usd") > F.lit(min_usd))
        .select("entity_id")
    )
    if interacted is not None:
        wallets = wallets.join(interacted.select("entity_id"), "entity_id", "left_anti")
    if holders is not None:
        wallets = wallets.join(holders.select("entity_id"), "entity_id", "left_semi")
    scored = score_wallets(events.join(wallets, "entity_id", "left_semi"), **score_options)
    return scored.orderBy(F.desc("score"), "wallet_address")


def outreach_conversions(outreach: DataFrame, events: DataFrame, action: str) -> DataFrame:
    """Outreach rows with their status, converted once the wallet acts afterwards.

    ``outreach(outreach_id, entity_id, outreach_ts, status)``.  The time of the
    first action at or after the outreach is the action table's as-of value
    read backwards: an action is compared with outreach times of its wallet
    only, never paired with all of them.
    """
    actions = events.where(F.col("event_type") == action).select("entity_id", F.col("timestamp").alias("__action_ts"))
    # mirrored time turns "first at or after" into "last at or before"
    mirror = F.timestamp_micros(-F.unix_micros("__t"))
    left = outreach.withColumn("__t", F.col("outreach_ts")).withColumn("__mirrored", mirror).drop("__t")
    right = actions.withColumn("__t", F.col("__action_ts")).withColumn("__mirrored_action", mirror).drop("__t")
    joined = asof_join(
        left, right, ["entity_id"], "__mirrored", "__mirrored_action", ["__action_ts"], bucket=timedelta(days=1)
    )
    return joined.select(
        *[F.col(c) for c in outreach.columns if c != "status"],
        F.when(F.col("__action_ts").isNotNull(), F.lit("converted")).otherwise(F.col("status")).alias("status"),
        F.col("__action_ts").alias("converted_at"),
    )

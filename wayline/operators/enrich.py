"""USD values of raw token amounts: metadata, as-of prices, coverage."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.scalars import is_stablecoin, month_of, shift, usd_value
from wayline.operators.asof import asof_join
from wayline.schema import ENRICHMENT_UPDATES
from wayline.sources.tokens import latest_metadata


def pending_events(
    events: DataFrame,
    start: datetime | Column,
    end: datetime | Column,
    *,
    pending: str = "amount_in",
    limit: int | None = None,
) -> DataFrame:
    """Events in a closed time range that have a raw amount and no USD yet.

    By default only ``amount_in_usd`` counts as "no USD yet", so an event with
    an outgoing amount alone stays pending; ``pending="any"`` also looks at the
    outgoing side.  ``limit`` is the batch size of a scheduled run.
    """
    if pending not in ("amount_in", "any"):
        raise ValueError(f"Unknown pending rule: {pending}")
    has_amount = F.col("amount_in").isNotNull() | F.col("amount_out").isNotNull()
    if pending == "amount_in":
        missing = F.col("amount_in_usd").isNull() & has_amount
    else:
        missing = (F.col("amount_in").isNotNull() & F.col("amount_in_usd").isNull()) | (
            F.col("amount_out").isNotNull() & F.col("amount_out_usd").isNull()
        )
    rows = events.where(F.col("timestamp").between(F.lit(start), F.lit(end)) & missing)
    return rows if limit is None else rows.limit(limit)


def with_metadata(events: DataFrame, metadata: DataFrame) -> DataFrame:
    """Add ``decimals_in`` and ``decimals_out``, null where a token is unknown.

    Events whose token is a stablecoin or null meet the stablecoins of the in-code
    list alone, so only the others move when the tokens are too many to broadcast.
    """
    tokens = latest_metadata(metadata)
    for side in ("out", "in"):
        one = tokens.select(
            F.col("chain").alias("__chain"),
            F.col("token_address").alias("__token"),
            F.col("decimals").alias(f"decimals_{side}"),
        )
        few = F.col(f"token_{side}").isNull() | is_stablecoin(F.col(f"token_{side}"))
        match = (F.col("chain") == F.col("__chain")) & (F.col(f"token_{side}") == F.col("__token"))
        near = events.where(few).join(F.broadcast(one.where(is_stablecoin(F.col("__token")))), match, "left")
        events = events.where(~few).join(one, match, "left").unionByName(near).drop("__chain", "__token")
    decimals = ("decimals_in", "decimals_out")
    return events.select(*[c for c in events.columns if c not in decimals], *decimals)


def token_legs(events: DataFrame) -> DataFrame:
    """The in and out amounts of each event as rows; a missing amount gives none."""
    sides = [
        F.struct(
            F.lit(side).alias("side"),
            F.col(f"token_{side}").alias("token_address"),
            F.col(f"amount_{side}").cast("decimal(38,0)").alias("amount"),
        )
        for side in ("in", "out")
    ]
    return (
        events.select("event_id", "chain", "timestamp", F.explode(F.array(*sides)).alias("leg"))
        .select("event_id", "chain", "timestamp", "leg.*")
        .where(F.col("amount").isNotNull())
    )


def price_legs(legs: DataFrame, metadata: DataFrame, prices: DataFrame, **asof_options) -> DataFrame:
    """Legs with ``decimals``, ``price_usd`` and ``amount_usd``.

    Stablecoins, by far the most frequent tokens, take no part in the as-of
    join, and look their metadata up among the stablecoins of the in-code list
    alone.  Other legs meet theirs in the as-of join, so they are shuffled once
    for both; an unknown token has no price.
    """
    tokens = latest_metadata(metadata).select("chain", "token_address", "decimals")
    stable = is_stablecoin(F.col("token_address"))
    right = prices.select("chain", "token_address", F.col("timestamp").alias("price_ts"), "price_usd", "inserted_at")
    priced = asof_join(
        legs.where(~stable),
        right,
        ["chain", "token_address"],
        "timestamp",
        "price_ts",
        ["price_usd"],
        newest_by="inserted_at",
        facts=tokens,
        **asof_options,
    )
    known = F.col("decimals").isNotNull()
    priced = priced.withColumns({c: F.when(known, F.col(c)) for c in ("price_ts", "price_usd")})
    unpriced = legs.where(stable).join(F.broadcast(tokens.where(stable)), ["chain", "token_address"], "left")
    legs = priced.unionByName(unpriced, allowMissingColumns=True)
    value = usd_value(F.col("amount"), F.col("token_address"), F.col("decimals"), F.col("price_usd"))
    return legs.withColumn("amount_usd", value)


def enrichment_updates(events: DataFrame, metadata: DataFrame, prices: DataFrame, **asof_options) -> DataFrame:
    """``(amount_in_usd, amount_out_usd, event_id)`` of the events with any USD value; ids are of the events' type."""
    legs = price_legs(token_legs(events), metadata, prices, **asof_options)
    value = {side: F.max(F.when(F.col("side") == side, F.col("amount_usd"))) for side in ("in", "out")}
    updates = legs.groupBy("event_id").agg(value["in"].alias("amount_in_usd"), value["out"].alias("amount_out_usd"))
    # a filter of the legs would be pushed below their value and work it out twice
    return updates.where("amount_in_usd IS NOT NULL OR amount_out_usd IS NOT NULL").select(*ENRICHMENT_UPDATES.fieldNames())


def enrich_window(
    events: DataFrame,
    metadata: DataFrame,
    prices: DataFrame,
    *,
    end: datetime | Column | None = None,
    window: timedelta = timedelta(hours=1),
    **pending_options,
) -> DataFrame:
    """Updates of the pending events of a trailing window that ends now or at ``end``."""
    until = F.current_timestamp() if end is None else F.lit(end)
    start = shift(until, -window.total_seconds())
    return enrichment_updates(pending_events(events, start, until, **pending_options), metadata, prices)


def apply_updates(events: DataFrame, updates: DataFrame) -> DataFrame:
    """Events with the updates filled in; an update never erases a value."""
    one = updates.groupBy(F.col("event_id").alias("__id")).agg(
        F.max("amount_in_usd").alias("__in"), F.max("amount_out_usd").alias("__out")
    )
    return (
        events.join(one, F.col("event_id") == F.col("__id"), "left")
        .withColumns(
            {
                "amount_in_usd": F.coalesce("__in", "amount_in_usd"),
                "amount_out_usd": F.coalesce("__out", "amount_out_usd"),
            }
        )
        .drop("__id", "__in", "__out")
    )


def affected_months(events: DataFrame, updates: DataFrame) -> DataFrame:
    """Month partitions an update touches: what a write-back has to replace."""
    return (
        events.join(updates.select("event_id"), "event_id", "left_semi")
        .select(month_of(F.col("timestamp")).alias("event_month"))
        .distinct()
    )


def coverage(
    events: DataFrame, *, end: datetime | Column | None = None, window: timedelta = timedelta(days=1)
) -> DataFrame:
    """How many events with an incoming amount have its USD value."""
    until = F.current_timestamp() if end is None else F.lit(end)
    start = shift(until, -window.total_seconds())
    has_amount, has_usd = F.col("amount_in").isNotNull(), F.col("amount_in_usd").isNotNull()
    return (
        events.where(F.col("timestamp").between(start, until))
        .agg(
            F.count_if(has_amount).alias("total"),
            F.count_if(has_usd).alias("enriched"),
            F.count_if(has_amount & ~has_usd).alias("pending"),
        )
        .withColumn("rate", F.coalesce(F.round(F.try_divide("enriched", "total"), 4), F.lit(0.0)))
    )


def link_usd(links: DataFrame, metadata: DataFrame, prices: DataFrame, **asof_options) -> DataFrame:
    """Links with ``amount_usd`` from the source side's token and time."""
    legs = links.withColumns(
        {"chain": F.col("src_chain"), "token_address": F.col("token"), "timestamp": F.col("src_block_time")}
    ).drop("amount_usd")
    priced = price_legs(legs, metadata, prices, **asof_options)
    return priced.drop("chain", "token_address", "timestamp", "decimals", "price_usd", "price_ts")

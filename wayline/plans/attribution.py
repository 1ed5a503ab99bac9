"""Campaigns and channels: what their sessions led to."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.scalars import nonempty
from wayline.operators.asof import asof_join
from wayline.operators.identity import resolve_to_wallet
from wayline.schema import extra_value
from wayline.session import materialize


def campaign_of() -> Column:
    """``utm_campaign``, or source and medium where the source has no campaign."""
    source, medium = nonempty(extra_value("utm_source")), nonempty(extra_value("utm_medium"))
    fallback = F.when(
        F.coalesce(source, medium).isNotNull(),
        F.concat_ws("/", F.coalesce(source, F.lit("(none)")), F.coalesce(medium, F.lit("(none)"))),
    )
    return F.coalesce(nonempty(extra_value("utm_campaign")), fallback, F.lit("(direct)"))


def channel_of() -> Column:
    source, medium = nonempty(extra_value("utm_source")), nonempty(extra_value("utm_medium"))
    return F.coalesce(medium, source, F.lit("direct"))


def campaign_sessions(
    events: DataFrame, edges: DataFrame | None, start: datetime, end: datetime, session: str = "session_start"
) -> DataFrame:
    """Sessions in a closed time range with campaign, channel and linked wallet.

    The wallet is null when the graph links none.
    """
    sessions = events.where(
        (F.col("event_type") == session) & F.col("timestamp").between(F.lit(start), F.lit(end))
    ).select(
        "entity_type",
        "entity_id",
        F.col("event_id").alias("session_id"),
        F.col("timestamp").alias("session_ts"),
        campaign_of().alias("campaign_id"),
        channel_of().alias("channel"),
    )
    wallets = resolve_to_wallet(sessions, edges)
    linked = (F.col("entity_type") == "wallet") | (F.col("wallet") != F.col("entity_id"))
    return sessions.join(wallets, ["entity_type", "entity_id"]).withColumn(
        "wallet", F.when(linked, F.col("wallet"))
    )


def last_touch(
    conversions: DataFrame,
    sessions: DataFrame,
    lookback: timedelta | None = None,
    key: str = "entity_id",
    session_key: str = "wallet",
) -> DataFrame:
    """Each conversion with the campaign of the last session of its entity before it.

    Without an identity link, ``key`` may name anything both sides share (a
    UTM tag, say) and ``lookback`` bounds the time between them.
    """
    touches = sessions.where(F.col(session_key).isNotNull()).select(
        F.col(session_key).alias(key), "session_ts", "session_id", "campaign_id", "channel"
    )
    return asof_join(
        conversions,
        touches,
        [key],
        "timestamp",
        "session_ts",
        ["session_id", "campaign_id", "channel"],
        newest_by="session_id",
        tolerance=lookback,
        bucket=timedelta(days=1),
    )


def attribute(
    events: DataFrame,
    edges: DataFrame | None,
    start: datetime,
    end: datetime,
    *,
    spend: DataFrame | None = None,
    by: str = "campaign_id",
    session: str = "session_start",
    bridge: str = "bridge_out",
    swap: str = "swap",
    lookback: timedelta | None = None,
) -> DataFrame:
    """Sessions, linked wallets, transfers, swaps and their USD value per campaign.

    An on-chain event counts for the last campaign session of its wallet before
    it, so no event counts twice.  ``spend(campaign_id, spend_usd)`` gives the
    acquisition cost per swap.
    """
    sessions = materialize(campaign_sessions(events, edges, start, end, session), "sessions")
    per_wallet = sessions.groupBy(by, "wallet").agg(F.count(F.lit(1)).alias("n"), F.min("channel").alias("first_channel"))
    reach = per_wallet.groupBy(by).agg(
        F.min("first_channel").alias("first_channel"),
        F.sum("n").alias("sessions"),
        F.count("wallet").alias("wallet_connects"),
    )
    conversions = events.where(F.col("event_type").isin(bridge, swap)).select(
        "entity_id", "event_type", "timestamp", "amount_out_usd"
    )
    touched = last_touch(conversions, sessions, lookback)
    outcome = touched.where(F.col("session_id").isNotNull()).groupBy(by).agg(
        F.count_if(F.col("event_type") == bridge).alias("bridges"),
        F.count_if(F.col("event_type") == swap).alias("swaps"),
        F.sum("amount_out_usd").alias("total_onchain_value_usd"),
    )
    result = reach.join(outcome, by, "left").withColumns(
        {
            "bridges": F.coalesce("bridges", F.lit(0)),
            "swaps": F.coalesce("swaps", F.lit(0)),
            "total_onchain_value_usd": F.coalesce("total_onchain_value_usd", F.lit(0)).cast("decimal(38,6)"),
        }
    )
    cost = F.lit(None).cast("double")
    if spend is not None:
        result = result.join(spend.groupBy(by).agg(F.sum("spend_usd").alias("spend_usd")), by, "left")
        cost = F.try_divide(F.col("spend_usd").cast("double"), F.col("swaps").cast("double"))
    result = result.withColumn("cac_per_swap", cost).drop("spend_usd")
    if by == "channel":
        return result.drop("first_channel")
    return result.withColumnRenamed("first_channel", "channel")


def attribute_campaign(events: DataFrame, edges: DataFrame | None, campaign_id: str, start, end, **options) -> DataFrame:
    """One campaign of ``attribute``.  Other campaigns take part: they may be the last touch."""
    result = attribute(events, edges, start, end, **options).where(F.col("campaign_id") == campaign_id)
    return result.withColumn("campaign_name", F.col("campaign_id"))


def compare_channels(events: DataFrame, edges: DataFrame | None, start, end, **options) -> DataFrame:
    """Channels by the on-chain value their sessions led to, highest first."""
    result = attribute(events, edges, start, end, by="channel", **options)
    return result.orderBy(F.desc("total_onchain_value_usd"), "channel")

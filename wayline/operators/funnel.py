"""Funnels, retention and drop-off."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.scalars import seconds_between, shift
from wayline.operators.trajectory import trajectory_across

QUERY = ["query_entity_id", "query_entity_type"]


def unified_funnel(
    events: DataFrame,
    links: DataFrame,
    *,
    session: str = "session_start",
    bridge: str = "bridge_out",
    swap: str = "swap",
    before: timedelta = timedelta(minutes=10),
    after: timedelta = timedelta(minutes=30),
    **options,
) -> DataFrame:
    """Session → bridge → swap per entity, from its cross-system trajectory.

    The first event of each type counts on its own, so a swap before the bridge
    gives a negative time.  Entities without events give no row.  The steps
    themselves are ``funnel_steps``: rows, not a list gathered per entity.
    """
    steps = funnel_steps(events, links, session=session, before=before, after=after, **options)
    return summarise(steps, session=session, bridge=bridge, swap=swap)


def funnel_steps(
    events: DataFrame,
    links: DataFrame,
    *,
    session: str = "session_start",
    before: timedelta = timedelta(minutes=10),
    after: timedelta = timedelta(minutes=30),
    ordered: bool = False,
    **options,
) -> DataFrame:
    """The events a unified funnel is made of."""
    return trajectory_across(events, links, session, before, after, ordered=ordered, **options)


def summarise(
    steps: DataFrame, *, session: str = "session_start", bridge: str = "bridge_out", swap: str = "swap"
) -> DataFrame:
    def first(event_type: str):
        return F.min(F.when(F.col("event_type") == event_type, F.col("timestamp")))

    return (
        steps.groupBy(*QUERY)
        .agg(
            F.count(F.lit(1)).alias("n_steps"),
            first(session).alias("session_ts"),
            first(bridge).alias("bridge_ts"),
            first(swap).alias("swap_ts"),
        )
        .withColumns(
            {
                "time_to_bridge": seconds_between(F.col("bridge_ts"), F.col("session_ts")),
                "time_to_swap": seconds_between(F.col("swap_ts"), F.col("bridge_ts")),
                "converted": F.col("swap_ts").isNotNull(),
            }
        )
    )


def ordered_funnel(
    events: DataFrame, steps: list[str], within: timedelta | None = None, entity: str = "entity_id"
) -> DataFrame:
    """Time of each step per entity, every step after the one before.

    Step k is the entity's first event of its type later than step k-1, and no
    later than ``within`` after step 1, which is its very first event of that
    type; ``funnel_scan.windowed_funnel`` counts from any start.  One join and one partial aggregation
    per step; an entity's events are never gathered in one task.
    """
    reached = (
        events.where(F.col("event_type") == steps[0]).groupBy(entity).agg(F.min("timestamp").alias("step_1_ts"))
    )
    for k, event_type in enumerate(steps[1:], start=2):
        previous = F.col(f"step_{k - 1}_ts")
        timely = F.col("__ts") > previous
        if within is not None:
            timely = timely & (F.col("__ts") <= shift(F.col("step_1_ts"), within))
        candidates = events.where(F.col("event_type") == event_type).select(
            F.col(entity).alias("__entity"), F.col("timestamp").alias("__ts")
        )
        step = (
            reached.where(previous.isNotNull())
            .join(candidates, (F.col(entity) == F.col("__entity")) & timely)
            .groupBy(entity)
            .agg(F.min("__ts").alias(f"step_{k}_ts"))
        )
        reached = reached.join(step, entity, "left")
    return reached


def funnel_counts(reached: DataFrame, steps: list[str]) -> DataFrame:
    """Entities per step and conversion from the first and the previous step."""
    counts = reached.agg(*[F.count(f"step_{k}_ts").alias(f"n{k}") for k in range(1, len(steps) + 1)])
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("step"),
                F.lit(name).alias("event_type"),
                F.col(f"n{k}").alias("n_entities"),
                F.round(F.try_divide(F.col(f"n{k}"), F.col("n1")), 6).alias("rate_from_first"),
                F.round(F.try_divide(F.col(f"n{k}"), F.col(f"n{max(k - 1, 1)}")), 6).alias("rate_from_previous"),
            )
            for k, name in enumerate(steps, start=1)
        ]
    )
    return counts.select(F.inline(rows))


def cohort_retention(
    events: DataFrame, activity: str | None = None, entity: str = "entity_id", channel: Column | None = None
) -> DataFrame:
    """Share of each first-week cohort active in the weeks after.

    ``activity`` limits what counts as active; the first touch is any event.
    With ``channel``, cohorts are those of a week and an acquisition channel
    (column ``channel``): what the column says of the entity's first event, of
    those at that time the one of the smallest event id.
    """
    week = F.date_trunc("week", "timestamp").alias("week")
    begins = [F.date_trunc("week", F.min("timestamp")).alias("cohort_week")]
    cohort = ["cohort_week"]
    if channel is not None:
        told = F.struct(channel.alias("channel"))  # a channel that is null counts as one
        begins.append(F.min_by(told, F.struct("timestamp", "event_id"))["channel"].alias("channel"))
        cohort.append("channel")
    first = events.groupBy(entity).agg(*begins)
    active = events if activity is None else events.where(F.col("event_type") == activity)
    weeks = active.select(entity, week).distinct()
    offset = F.floor(F.datediff("week", "cohort_week") / 7).cast("int")
    returned = (
        weeks.join(first, entity)
        .groupBy(*cohort, offset.alias("week_no"))
        .agg(F.count(F.lit(1)).alias("n_active"))
    )
    sizes = first.groupBy(*cohort).agg(F.count(F.lit(1)).alias("cohort_size"))
    sizes = sizes.select(*[F.col(c).alias(f"__{c}") for c in cohort], "cohort_size")
    same = [returned["cohort_week"] == sizes["__cohort_week"]]
    if channel is not None:
        same.append(returned["channel"].eqNullSafe(sizes["__channel"]))
    return (
        returned.join(sizes, same)
        .drop(*[f"__{c}" for c in cohort])
        .withColumn("share", F.round(F.col("n_active") / F.col("cohort_size"), 6))
    )


def retention_table(retention: DataFrame, weeks: int) -> DataFrame:
    """Cohorts as rows, week numbers as columns."""
    return retention.groupBy("cohort_week").pivot("week_no", list(range(weeks))).agg(F.first("share"))


def drop_off(events: DataFrame, did, never, entity: str = "entity_id") -> DataFrame:
    """Of the entities with an event ``did``, how many have no event ``never``.

    Both are predicates (Columns) on events.
    """
    per_entity = events.where(did | never).groupBy(entity).agg(
        F.max(F.coalesce(did, F.lit(False))).alias("__did"), F.max(F.coalesce(never, F.lit(False))).alias("__never")
    )
    return (
        per_entity.where("__did")
        .agg(F.count(F.lit(1)).alias("n_entities"), F.count_if(~F.col("__never")).alias("n_dropped"))
        .withColumn("share", F.round(F.try_divide("n_dropped", "n_entities"), 6))
    )

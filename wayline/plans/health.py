"""Health signals of integrators: one metric row each, seven rules."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Rule names.
HEURISTICS = [
    "high_bridge_only_ratio",
    "outdated_sdk",
    "high_error_rate",
    "stalled_onboarding",
    "churn_imminent",
    "ready_for_upgrade",
    "multi_chain_opportunity",
]
SEVERITY_ORDER = {"critical": 0, "warning": 1, "info": 2}


@dataclass(frozen=True)
class Thresholds:
    bridge_only_ratio: float = 0.7
    error_rate: float = 0.05
    stalled_days: int = 14
    declining_weeks: int = 3
    upgrade_weekly_events: int = 1000


def weekly_volume(events: DataFrame) -> DataFrame:
    """Events per integrator and week."""
    return events.groupBy("integrator_id", F.date_trunc("week", "timestamp").alias("week")).agg(
        F.count(F.lit(1)).alias("n")
    )


def declining_streak(weekly: DataFrame) -> DataFrame:
    """Number of weekly declines in a row up to an integrator's last week.

    Runs over the weekly rollup: one row per integrator and week.
    """
    by_week = W.partitionBy("integrator_id").orderBy("week")
    backwards = W.partitionBy("integrator_id").orderBy(F.desc("week"))
    declined = F.col("n") < F.lag("n").over(by_week)
    return (
        weekly.withColumn("__declined", F.coalesce(declined, F.lit(False)))
        .withColumn("__broken", F.max(~F.col("__declined")).over(backwards))
        .groupBy("integrator_id")
        .agg(F.count_if(~F.col("__broken")).alias("declining_weeks"), F.max_by("n", "week").alias("last_week_events"))
    )


def integrator_metrics(events: DataFrame, integrators: DataFrame, latest_sdk: str) -> DataFrame:
    """Everything the rules look at, one row per integrator.

    ``events`` are canonical events with ``integrator_id``; ``integrators`` is
    ``(integrator_id, sdk_version, tier, signed_up_at, supported_chains)``.
    """
    per_user = events.groupBy("integrator_id", "entity_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("event_type") == "bridge_out").alias("bridges"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.max("timestamp").alias("last_ts"),
    )
    usage = per_user.groupBy("integrator_id").agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if((F.col("bridges") > 0) & (F.col("bridges") == F.col("n"))).alias("bridge_only_users"),
        F.count_if(F.col("bridges") > 0).alias("bridge_users"),
        F.sum("n").alias("n_events"),
        F.sum("errors").alias("n_errors"),
        F.max("last_ts").alias("last_ts"),
    )
    # distinct chains are few, whatever the traffic
    chains = (
        events.where(F.col("chain") != "")
        .select("integrator_id", "chain")
        .distinct()
        .groupBy("integrator_id")
        .agg(F.array_sort(F.collect_list("chain")).alias("used_chains"))
    )
    streak = declining_streak(weekly_volume(events))
    return (
        integrators.join(usage, "integrator_id", "left")
        .join(chains, "integrator_id", "left")
        .join(streak, "integrator_id", "left")
        .withColumns(
            {
                "bridge_only_ratio": F.try_divide("bridge_only_users", "bridge_users"),
                "error_rate": F.try_divide("n_errors", "n_events"),
                "unsupported_chains": F.array_except(
                    F.coalesce("used_chains", F.array().cast("array<string>")), "supported_chains"
                ),
                "sdk_is_old": _version(F.col("sdk_version")) < _version(F.lit(latest_sdk)),
            }
        )
    )


def _version(text: Column) -> Column:
    """Dotted version as three comparable numbers."""
    parts = F.split(text, r"\.")
    return F.struct(
        *[F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0)).alias(f"p{i}") for i in range(3)]
    )


def evaluate(
    events: DataFrame,
    integrators: DataFrame,
    *,
    as_of: datetime,
    latest_sdk: str,
    thresholds: Thresholds | None = None,
    integrator_id: str | None = None,
) -> DataFrame:
    """One row per integrator and fired rule, most severe first."""
    t = thresholds or Thresholds()
    if integrator_id is not None:
        events = events.where(F.col("integrator_id") == integrator_id)
        integrators = integrators.where(F.col("integrator_id") == integrator_id)
    now = F.lit(as_of).cast("timestamp")
    quiet = F.datediff(now, F.coalesce("last_ts", "signed_up_at")) >= t.stalled_days
    rules: dict[str, tuple[Column, str, str, str]] = {
        "high_bridge_only_ratio": (
            F.col("bridge_only_ratio") >= t.bridge_only_ratio, "warning",
            "Most users bridge and do nothing further", "review_post_bridge_flow",
        ),
        "outdated_sdk": (F.col("sdk_is_old"), "warning", "The SDK is older than the latest version", "offer_upgrade_help"),
        "high_error_rate": (
            F.col("error_rate") >= t.error_rate, "critical", "Errors are a large share of events", "open_incident",
        ),
        "stalled_onboarding": (quiet, "warning", "No live traffic for two weeks", "schedule_call"),
        "churn_imminent": (
            F.col("declining_weeks") >= t.declining_weeks, "critical", "Volume fell several weeks in a row",
            "contact_account_owner",
        ),
        "ready_for_upgrade": (
            (F.col("last_week_events") >= t.upgrade_weekly_events) & (F.col("tier") == "standard"), "info",
            "Usage fits a higher tier", "propose_upgrade",
        ),
        "multi_chain_opportunity": (
            F.size("unsupported_chains") > 0, "info", "Users go to chains that are not supported", "propose_chains",
        ),
    }
    fired = F.array_compact(
        F.array(
            *[
                F.when(
                    rules[name][0],
                    F.struct(
                        F.lit(name).alias("heuristic_name"),
                        F.lit(rules[name][1]).alias("severity"),
                        F.lit(SEVERITY_ORDER[rules[name][1]]).alias("severity_rank"),
                        F.lit(rules[name][2]).alias("recommendation"),
                        F.lit(rules[name][3]).alias("suggested_action"),
                    ),
                )
                for name in HEURISTICS
            ]
        )
    )
    signals = integrator_metrics(events, integrators, latest_sdk).select(
        "integrator_id", F.explode(fired).alias("__signal")
    )
    return (
        signals.select("integrator_id", "__signal.*", now.alias("detected_at"))
        .orderBy("severity_rank", "integrator_id", "heuristic_name")
        .select("integrator_id", "heuristic_name", "severity", "detected_at", "recommendation", "suggested_action")
    )

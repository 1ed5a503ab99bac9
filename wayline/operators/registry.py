"""Event-type registry: known types, categories, required properties."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.schema import EVENT_COLUMNS, extra_map
from wayline.session import constant_frame


@dataclass(frozen=True)
class EventType:
    category: str
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()


# Event types, their category, required and optional properties.
EVENT_TYPES = {
    "swap": EventType("transaction", ("token_in", "token_out", "amount_in", "amount_out"), ("aggregator", "venue")),
    "bridge_out": EventType("transaction", ("destination_chain", "link_key"), ("link_key_type",)),
    "bridge_in": EventType("transaction", ("source_chain", "link_key"), ("link_key_type",)),
    "lend_deposit": EventType("transaction", ("token_in", "amount_in"), ("venue",)),
    "lend_borrow": EventType("transaction", ("token_out", "amount_out"), ("venue",)),
    "lend_repay": EventType("transaction", ("token_in", "amount_in"), ("venue",)),
    "lend_withdraw": EventType("transaction", ("token_out", "amount_out"), ("venue",)),
    "perp_open": EventType("transaction", ("token_in", "amount_in"), ("venue",)),
    "perp_close": EventType("transaction", ("token_out", "amount_out"), ("venue",)),
    "perp_fill": EventType("transaction", ("token_in", "token_out", "amount_in", "amount_out"), ("venue",)),
    "lp_add": EventType("transaction", ("token_in", "amount_in"), ("token_out", "amount_out", "venue")),
    "lp_remove": EventType("transaction", ("token_out", "amount_out"), ("token_in", "amount_in", "venue")),
    "stake": EventType("transaction", ("token_in", "amount_in"), ("venue",)),
    "unstake": EventType("transaction", ("token_out", "amount_out"), ("venue",)),
    "claim": EventType("transaction", (), ("token_out", "amount_out", "venue")),
    "nft_buy": EventType("transaction", ("token_in", "amount_in"), ("token_out", "venue")),
    "nft_sell": EventType("transaction", ("token_out", "amount_out"), ("token_in", "venue")),
    "transfer_in": EventType("transaction", ("token_in", "amount_in"), ("counterparty",)),
    "transfer_out": EventType("transaction", ("token_out", "amount_out"), ("counterparty",)),
    "swap_internal": EventType("transaction", ("token_in", "token_out", "amount_in", "amount_out"), ("venue",)),
    "pageview": EventType("acquisition", ("url", "session_id"), ("referrer", "utm_source", "utm_medium", "utm_campaign")),
    "session_start": EventType("acquisition", ("session_id", "client_id"), ("utm_source", "utm_medium", "utm_campaign")),
    "signup": EventType("lifecycle", ("user_id",), ("email_hash", "referral_code")),
    "upgrade": EventType("lifecycle", ("user_id", "plan"), ("amount_usd",)),
    "api_call": EventType("product", ("endpoint",), ("method", "status_code", "latency_ms")),
}

REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("event_type", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("required", T.ArrayType(T.StringType())),
        T.StructField("optional", T.ArrayType(T.StringType())),
    ]
)


def registry_frame(spark: SparkSession, types: dict[str, EventType] | None = None) -> DataFrame:
    """The registry as a table; pass ``EVENT_TYPES | {...}`` to extend it."""
    rows = [
        {"event_type": name, "category": t.category, "required": list(t.required), "optional": list(t.optional)}
        for name, t in (EVENT_TYPES if types is None else types).items()
    ]
    return constant_frame(spark, rows, REGISTRY_SCHEMA)


def validate(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Add ``is_valid``, ``registry_category`` and ``missing``; no row is dropped.

    An event is valid when its type is registered.  ``missing`` lists required
    properties found neither in a non-null column nor in ``extra``.
    """
    spec = registry.select(
        F.col("event_type").alias("__type"),
        F.col("category").alias("registry_category"),
        F.col("required").alias("__required"),
    )
    columns = set(events.columns)
    present = F.array_compact(
        F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in EVENT_COLUMNS if c in columns and c != "extra"])
    )
    if "extra" in columns:
        keys = F.coalesce(F.map_keys(extra_map("extra")), F.array().cast("array<string>"))
        present = F.concat(present, keys)
    joined = events.join(spec, F.col("event_type") == F.col("__type"), "left")
    return joined.select(
        *[F.col(c) for c in events.columns],
        F.col("__type").isNotNull().alias("is_valid"),
        "registry_category",
        F.array_except("__required", present).alias("missing"),
    )


def freshness(events: DataFrame, by: list[str], as_of, max_age_seconds: float, min_rows: int) -> DataFrame:
    """Row count and newest event per group, with a verdict on both."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("newest")) / F.lit(1_000_000.0)
    return (
        events.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.max("timestamp").alias("newest"))
        .withColumn("age_seconds", age)
        .withColumn("is_fresh", F.col("age_seconds") <= F.lit(float(max_age_seconds)))
        .withColumn("has_rows", F.col("n_rows") >= F.lit(min_rows))
    )

"""Matching the two sides of a transfer by its link key."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayline.operators.asof import asof_join
from wayline.schema import BRIDGE_LINKS, conform

ORDER = ("timestamp", "event_id")


def _side(
    events: DataFrame, fields: dict[str, Column], order_by: tuple[str, ...], keep_last: bool, columns: list[str] | None
) -> DataFrame:
    """One event per link key, by an aggregate: a key with very many events
    (a chain id used as key) is reduced before it is shuffled."""
    order = F.struct(*[F.col(c) for c in order_by])
    wanted = {name: column for name, column in fields.items() if columns is None or name in columns}
    row = F.struct(*[column.alias(name) for name, column in wanted.items()] or [F.lit(True)])
    pick = F.max if keep_last else F.min
    return (
        events.where(F.col("link_key") != "")
        .groupBy("link_key")
        .agg(pick(F.struct(order.alias("o"), row.alias("row"))).alias("__side"))
        .select("link_key", *[F.col(f"__side.row.{name}").alias(name) for name in wanted])
    )


def last_outs(outs: DataFrame, order_by: tuple[str, ...] = ORDER, columns: list[str] | None = None) -> DataFrame:
    """The out each link key stands for: a later one replaces an earlier one."""
    return _side(
        outs,
        {
            "link_key_type": F.coalesce("link_key_type", F.lit("unknown")),
            "src_chain": F.col("chain"),
            "src_block_time": F.col("timestamp"),
            "src_tx_hash": F.col("tx_hash"),
            "src_entity_id": F.col("entity_id"),
            "src_event_id": F.col("event_id"),
            "token": F.col("token_out"),
            "amount": F.col("amount_out"),
        },
        order_by,
        keep_last=True,
        columns=columns,
    )


def first_ins(ins: DataFrame, order_by: tuple[str, ...] = ORDER, columns: list[str] | None = None) -> DataFrame:
    """The in each link key is matched with: the first one."""
    return _side(
        ins,
        {
            "dst_chain": F.col("chain"),
            "dst_block_time": F.col("timestamp"),
            "dst_tx_hash": F.col("tx_hash"),
            "dst_entity_id": F.col("entity_id"),
            "dst_event_id": F.col("event_id"),
        },
        order_by,
        keep_last=False,
        columns=columns,
    )


def reconcile(
    outs: DataFrame,
    ins: DataFrame,
    out_order: tuple[str, ...] = ORDER,
    in_order: tuple[str, ...] = ORDER,
    columns: list[str] | None = None,
) -> DataFrame:
    """Every registered out with its in, if any, and ``is_matched``.

    Both sides are unique per key, so the join emits no pairs within a key.
    Time and chains take no part: an in may precede its out.  ``columns`` names
    those of the two sides that are wanted: Catalyst can't prune the others.
    """
    ins = first_ins(ins, in_order, columns).withColumn("__in", F.lit(True))
    joined = last_outs(outs, out_order, columns).join(ins, "link_key", "left")
    return joined.withColumn("is_matched", F.col("__in").isNotNull()).drop("__in")


def match(outs: DataFrame, ins: DataFrame, **options) -> DataFrame:
    """The completed links."""
    return reconcile(outs, ins, **options).where("is_matched").drop("is_matched")


def pending(outs: DataFrame, ins: DataFrame, **order) -> DataFrame:
    """Outs without an in."""
    dst = ["dst_chain", "dst_block_time", "dst_tx_hash", "dst_entity_id", "dst_event_id"]
    return reconcile(outs, ins, **order).where(~F.col("is_matched")).drop("is_matched", *dst)


def link_stats(reconciled: DataFrame) -> DataFrame:
    return reconciled.agg(
        F.count_if(~F.col("is_matched")).alias("pending"), F.count_if("is_matched").alias("completed")
    )


def match_window(
    events: DataFrame, end: datetime, lookback: timedelta = timedelta(minutes=30)
) -> DataFrame:
    """Outs of the lookback against ins of twice the lookback, up to ``end``."""
    until = F.col("timestamp") <= F.lit(end)
    outs = events.where((F.col("event_type") == "bridge_out") & until & (F.col("timestamp") >= F.lit(end - lookback)))
    ins = events.where((F.col("event_type") == "bridge_in") & until & (F.col("timestamp") >= F.lit(end - 2 * lookback)))
    return reconcile(outs, ins)


def match_strict(outs: DataFrame, ins: DataFrame, max_delay: timedelta | None = None) -> DataFrame:
    """Typed match for keys that repeat.

    An in takes the latest out of the same (link_key_type, link_key) at or
    before it, no older than ``max_delay``; an out goes to its first in only.
    An as-of join, so a key with many transfers gives no pairs to filter.
    """
    keys = ["link_key_type", "link_key"]
    src = {
        "src_chain": F.col("chain"),
        "src_tx_hash": F.col("tx_hash"),
        "src_entity_id": F.col("entity_id"),
        "src_event_id": F.col("event_id"),
        "token": F.col("token_out"),
        "amount": F.col("amount_out"),
    }
    right = outs.where(F.col("link_key") != "").select(
        *keys, F.col("timestamp").alias("src_block_time"), *[c.alias(n) for n, c in src.items()]
    )
    left = ins.where(F.col("link_key") != "").select(
        *keys,
        F.col("chain").alias("dst_chain"),
        F.col("timestamp").alias("dst_block_time"),
        F.col("tx_hash").alias("dst_tx_hash"),
        F.col("entity_id").alias("dst_entity_id"),
        F.col("event_id").alias("dst_event_id"),
    )
    paired = asof_join(
        left, right, keys, "dst_block_time", "src_block_time", list(src), newest_by="src_event_id",
        tolerance=max_delay, bucket=timedelta(days=1),
    ).where(F.col("src_event_id").isNotNull())
    dst = ["dst_block_time", "dst_event_id", "dst_chain", "dst_tx_hash", "dst_entity_id"]
    out = [*keys, "src_block_time", *src]
    return (
        paired.groupBy(*out)
        .agg(F.min(F.struct(*dst)).alias("__in"))
        .select(*out, *[F.col(f"__in.{c}").alias(c) for c in dst])
    )


def sample_links(links: DataFrame, per_family: int = 50) -> DataFrame:
    """A fixed sample of links of each key type, for checking by hand.

    The lowest hashes of a type: each task keeps at most ``per_family`` rows of
    a type before the shuffle, so a dominant type costs nothing.
    """
    order = W.partitionBy("link_key_type").orderBy(F.sha2("link_key", 256))
    return (
        links.withColumn("sample_no", F.row_number().over(order))
        .where(F.col("sample_no") <= per_family)
    )


def link_rows(links: DataFrame, validated_at: datetime | Column | None = None) -> DataFrame:
    """Rows of the link table; USD is filled in later, confidence starts at 1."""
    when = F.current_timestamp() if validated_at is None else F.lit(validated_at)
    return conform(
        links.withColumns({"amount_usd": F.lit(None), "link_confidence": F.lit(1.0), "validated_at": when}),
        BRIDGE_LINKS,
    )

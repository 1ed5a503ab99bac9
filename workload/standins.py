"""The given tables in the shape the operators take.

The tables have no chains, tokens or wallets, so customers, orders and line
items stand in for them.  Everything here is a projection or a bounded group of
the given rows, so the work grows with the tables.  Projections of one row are
part of the plan that reads them: a query computes the columns it takes, and no
wide event or log is shuffled or written before the operator starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions.scalars import event_id
from wayline.operators import decode as D
from wayline.schema import CANONICAL_EVENTS, conform


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def app_events(spark: SparkSession, sf: str) -> DataFrame:
    """Product events: one entity per user."""
    category = (
        F.when(F.col("event_type") == "signup", "lifecycle")
        .when(F.col("event_type").isin("view", "click"), "acquisition")
        .otherwise("product")
    )
    source_id = F.col("event_id").cast("string")
    rows = load(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("entity_id"),
        F.lit("user_id").alias("entity_type"),
        event_id(F.lit("app"), source_id).alias("event_id"),
        "event_type",
        category.alias("event_category"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.lit("app").alias("source_system"),
        source_id.alias("source_event_id"),
        F.col("props").alias("extra"),
    )
    return conform(rows, CANONICAL_EVENTS)


APP_EVENTS_SQL = """
ev AS (
  SELECT CAST(user_id AS VARCHAR) AS entity_id, sha256('app:' || event_id) AS event_id, event_type,
         ts AS "timestamp", CAST(event_id AS VARCHAR) AS source_event_id, props AS extra
  FROM events
)"""


def order_outs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as transfers leaving a customer."""
    rows = load(spark, sf, "orders").select(
        F.concat(F.lit("c:"), "o_custkey").alias("entity_id"),
        F.lit("wallet").alias("entity_type"),
        F.concat(F.lit("o:"), "o_orderkey").alias("event_id"),
        F.lit("bridge_out").alias("event_type"),
        F.lit("transaction").alias("event_category"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.lit("evm_sales").alias("source_system"),
        F.lit("sales").alias("chain"),
        F.concat(F.lit("t"), "o_orderkey").alias("tx_hash"),
        F.lit("order").alias("token_out"),
        F.round(F.col("o_totalprice") * 100).cast("decimal(38,0)").alias("amount_out"),
        F.col("o_totalprice").cast("decimal(38,6)").alias("amount_out_usd"),
        F.col("o_orderkey").cast("string").alias("link_key"),
        F.col("o_orderpriority").alias("link_key_type"),
        F.col("o_orderstatus").alias("protocol"),
    )
    return conform(rows, CANONICAL_EVENTS)


def line_hash():
    """Identity of a line item from all of its columns."""
    return F.sha2(
        F.concat_ws(
            "|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.round(F.col("l_extendedprice") * 100).cast("bigint"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")),
            F.round(F.col("l_discount") * 100).cast("bigint"), F.round(F.col("l_tax") * 100).cast("bigint"),
            F.round("l_quantity").cast("bigint"), "l_returnflag", "l_linestatus",
        ),
        256,
    )


def lineitem_ins(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as transfers arriving at a supplier; ``event_id`` is a hash of
    the whole row because (l_orderkey, l_linenumber) repeats."""
    rows = load(spark, sf, "lineitem").select(
        F.concat(F.lit("s:"), "l_suppkey").alias("entity_id"),
        F.lit("wallet").alias("entity_type"),
        line_hash().alias("event_id"),
        F.lit("bridge_in").alias("event_type"),
        F.lit("transaction").alias("event_category"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.lit("evm_depot").alias("source_system"),
        F.lit("depot").alias("chain"),
        F.concat(F.lit("t"), "l_orderkey").alias("tx_hash"),
        F.col("l_orderkey").cast("string").alias("link_key"),
        F.col("l_returnflag").alias("protocol"),
    )
    return conform(rows, CANONICAL_EVENTS)


OUTS_SQL = """
outs AS (
  SELECT 'c:' || o_custkey AS entity_id, 'o:' || o_orderkey AS event_id, o_orderdate AS "timestamp", 'sales' AS chain,
         't' || o_orderkey AS tx_hash, CAST(o_orderkey AS VARCHAR) AS link_key, o_orderpriority AS link_key_type,
         CAST(round(o_totalprice * 100) AS BIGINT) AS amount, o_orderstatus AS protocol, o_totalprice
  FROM orders
)"""
LINE_HASH_SQL = """sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT),
    CAST(epoch(l_shipdate) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT),
    CAST(round(l_quantity) AS BIGINT), l_returnflag, l_linestatus))"""
INS_SQL = f"""
ins AS (
  SELECT 's:' || l_suppkey AS entity_id, {LINE_HASH_SQL} AS event_id,
         l_shipdate AS "timestamp", 'depot' AS chain, 't' || l_orderkey AS tx_hash,
         CAST(l_orderkey AS VARCHAR) AS link_key, l_returnflag AS protocol
  FROM lineitem
)"""
LINKS_SQL = """
links AS (
  SELECT o.*, i.entity_id AS dst_entity_id, i.event_id AS dst_event_id, i."timestamp" AS dst_ts, i.chain AS dst_chain
  FROM outs o
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY link_key ORDER BY "timestamp", event_id) AS rn FROM ins) i
    ON i.link_key = o.link_key AND i.rn = 1
)"""


def _word(column) -> F.Column:
    return F.lpad(F.lower(F.hex(column.cast("bigint"))), 64, "0")


def chain_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Line items encoded as raw logs, an event signature per row.

    The signature follows from (l_partkey + l_suppkey) mod 11; 10 is one that
    no decoder knows.  Words hold order, part, supplier and price in cents.
    """
    signatures = [d.topic0 for d in D.DEFAULT_DECODERS] + ["0x" + "99" * 32]
    kind = F.pmod(F.col("l_partkey") + F.col("l_suppkey"), F.lit(11)).cast("int")
    part, supp, order = (_word(F.col(c)) for c in ("l_partkey", "l_suppkey", "l_orderkey"))
    cents, qty = _word(F.round(F.col("l_extendedprice") * 100)), _word(F.round("l_quantity"))
    minus = F.translate(_word(F.round("l_quantity") - 1), "0123456789abcdef", "fedcba9876543210")
    zero = F.lit("0" * 64)
    sixty_four, twenty = F.lit(f"{96:064x}"), F.lit(f"{20:064x}")
    receiver = F.rpad(F.right(part, F.lit(40)), 64, "0")
    bodies = [
        [cents], [cents], [cents], [cents],
        [zero, cents, qty, zero],
        [minus, cents, zero, zero, zero],
        [qty, sixty_four, cents, twenty, receiver],
        [part, supp, cents, qty, zero, zero, zero, zero, zero, zero],
        [cents, sixty_four, zero],
        [part, cents, sixty_four, zero],
        [cents],
    ]
    data = F.lit("0x")
    for i, words in enumerate(bodies):
        data = F.when(kind == i, F.concat(F.lit("0x"), *words)).otherwise(data)
    topic0 = F.get(F.array(*[F.lit(s) for s in signatures]), kind)

    def topic(word):
        return F.concat(F.lit("0x"), word)

    topics = F.array(topic0, topic(supp), topic(part), topic(order))
    return load(spark, sf, "lineitem").select(
        F.lit("evm_base").alias("source_system"),
        F.concat(F.lit("0x"), F.right(part, F.lit(40))).alias("address"),
        F.concat(F.lit("0x"), F.lower(F.hex("l_orderkey"))).alias("blockNumber"),
        F.concat(F.lit("0x"), F.lower(F.hex("l_linenumber"))).alias("logIndex"),
        F.concat(F.lit("0x"), F.right(order, F.lit(40))).alias("transactionHash"),
        data.alias("data"),
        topics.alias("topics"),
        F.col("l_shipdate").cast("timestamp").alias("block_time"),
        kind.alias("kind"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag",
    )


LOGS_SQL = """
logs AS (
  SELECT (l_partkey + l_suppkey) % 11 AS kind, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_returnflag,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_quantity) AS BIGINT) AS qty,
         '0x' || lpad(lower(to_hex(l_partkey)), 40, '0') AS part, '0x' || lpad(lower(to_hex(l_suppkey)), 40, '0') AS supp,
         '0x' || lpad(lower(to_hex(l_orderkey)), 40, '0') AS ord
  FROM lineitem
)"""

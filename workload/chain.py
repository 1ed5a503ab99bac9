"""Raw chain logs encoded from line items, and what decoding gives back."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from wayline.functions import hexwords as H
from wayline.operators import decode as D
from wayline.sinks import tables
from wayline.sources import chain_logs as C
from workload.registry import query
from workload.standins import LOGS_SQL, chain_logs, load

KEEP = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def logs(spark, sf, kinds=None):
    """Normalised logs plus the columns they were made from."""
    landed = chain_logs(spark, sf)
    if kinds is not None:
        landed = landed.where(F.col("kind").isin(kinds))
    columns = {f"topic{i}": F.get("topics", F.lit(i)) for i in range(4)}
    return landed.withColumns(columns).select(
        "source_system", F.lit("base").alias("chain"), F.col("l_orderkey").alias("block_number"), "block_time",
        F.col("transactionHash").alias("tx_hash"), F.col("l_linenumber").cast("bigint").alias("log_index"), "address",
        "topic0", "topic1", "topic2", "topic3", "data", "kind", *KEEP,
    )


@query(
    "logs_normalised",
    f"""WITH {LOGS_SQL} SELECT 'base' AS chain, l_orderkey AS block_number, ord AS tx_hash, l_linenumber::BIGINT AS log_index, part AS address,
  '0x' || lpad(supp[3:], 64, '0') AS topic1, '0x' || lpad(part[3:], 64, '0') AS topic2, '0x' || lpad(ord[3:], 64, '0') AS topic3, l_shipdate AS block_time FROM logs""",
)
def logs_normalised(spark, sf):
    rows = C.normalise_logs(chain_logs(spark, sf))
    return rows.select("chain", "block_number", "tx_hash", "log_index", "address", "topic1", "topic2", "topic3", "block_time")


@query(
    "log_rows",
    f"""WITH {LOGS_SQL} SELECT ord AS tx_hash, l_linenumber::BIGINT AS log_index, part AS address, 0 AS decoded, 0 AS decoder_version,
  TIMESTAMP '2024-01-01' AS inserted_at FROM logs""",
)
def log_rows(spark, sf):
    rows = tables.log_rows(C.normalise_logs(chain_logs(spark, sf)), datetime(2024, 1, 1))
    return rows.select(
        "tx_hash", "log_index", "address", *[F.col(c).cast("int").alias(c) for c in ("decoded", "decoder_version")], "inserted_at"
    )


SCANNED = "l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30'"


@query(
    "log_scan",
    f"WITH {LOGS_SQL} SELECT kind, count(*) AS n, min(l_shipdate) AS first_ts FROM logs WHERE {SCANNED} AND l_partkey IN (5, 171, 1616) GROUP BY 1",
)
def log_scan(spark, sf):
    addresses = [f"0x{p:040X}" for p in (5, 171, 1616)]
    rows = C.scan_logs(logs(spark, sf), datetime(1996, 1, 1), datetime(1997, 6, 30), addresses)
    return rows.groupBy(F.col("kind").cast("bigint").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("block_time").alias("first_ts"))


@query(
    "known_log_scan",
    f"""WITH {LOGS_SQL} SELECT CASE WHEN kind < 4 THEN kind ELSE 9 END AS kind, count(*) AS n FROM logs WHERE {SCANNED} AND kind <> 10 GROUP BY 1""",
)
def known_log_scan(spark, sf):
    topics = D.default_registry().topic0s()
    rows = C.scan_known_logs(logs(spark, sf), topics, datetime(1996, 1, 1), datetime(1997, 6, 30))
    kind = F.when(F.col("kind") < 4, F.col("kind")).otherwise(9)
    return rows.groupBy(kind.cast("bigint").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def blocks(spark, sf):
    """A block per order, timed by the order date."""
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return load(spark, sf, "orders").select(
        F.lit("base").alias("chain"), F.col("o_orderkey").alias("number"), F.concat(F.lit("0x"), F.hex(seconds)).alias("timestamp_hex")
    )


@query(
    "block_times",
    f"""WITH {LOGS_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN l_shipdate ELSE o_orderdate END AS block_time, count(*) AS n
FROM logs JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3""",
)
def block_times(spark, sf):
    landed = chain_logs(spark, sf).withColumn("block_time", F.when(F.col("l_returnflag") == "A", F.col("block_time")))
    timed = C.attach_block_times(C.normalise_logs(landed), blocks(spark, sf))
    return timed.groupBy(
        F.col("block_number").alias("l_orderkey"), F.col("log_index").cast("int").alias("l_linenumber"), "block_time"
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "block_bounds",
    """SELECT 'base' AS chain, min(o_orderkey) AS start_block, max(o_orderkey) AS end_block FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1997-02-01' AND TIMESTAMP '1997-02-28'""",
)
def block_bounds(spark, sf):
    return C.block_bounds(blocks(spark, sf), datetime(1997, 2, 1), datetime(1997, 2, 28))


@query(
    "chain_union",
    f"WITH {LOGS_SQL} SELECT l_returnflag AS chain, 'evm_' || l_returnflag AS source_system, count(*) AS n FROM logs GROUP BY 1, 2",
)
def chain_union(spark, sf):
    all_logs = chain_logs(spark, sf)
    frames = {flag: all_logs.where(F.col("l_returnflag") == flag) for flag in ("A", "N", "R")}
    return C.union_chains(frames).groupBy("chain", "source_system").agg(F.count(F.lit(1)).alias("n"))


def _decoded(spark, sf, kinds):
    return D.decode_logs(logs(spark, sf, kinds), keep=KEEP)


def _bigint(*columns):
    return [F.col(c).cast("bigint").alias(c) for c in columns]


TOKEN_SQL = f"""WITH {LOGS_SQL} SELECT {{kind}} AS kind, supp AS entity_id, CASE {{kind}} WHEN 2 THEN 'ETH' ELSE part END AS token_out, cents AS amount_out,
  CASE WHEN {{kind}} < 2 THEN part END AS counterparty,
  CASE {{kind}} WHEN 0 THEN '{{{{"receiver":"' || part || '"}}}}' WHEN 1 THEN '{{{{"spender":"' || part || '"}}}}' WHEN 2 THEN '{{{{"action":"wrap_eth"}}}}'
    ELSE '{{{{"action":"unwrap_eth"}}}}' END AS extra, sha256('evm_base:' || ord || ':' || l_linenumber) AS event_id FROM logs WHERE kind = {{kind}}"""

for _kind, _name in enumerate(["transfer", "approval", "weth_deposit", "weth_withdrawal"]):

    def _token_query(spark, sf, kind=_kind):
        return _decoded(spark, sf, [kind]).select(
            F.lit(kind).alias("kind"), "entity_id", "token_out", *_bigint("amount_out"), "counterparty", "extra", "event_id"
        )

    query(f"decode_{_name}", TOKEN_SQL.format(kind=_kind))(_token_query)


@query(
    "decode_uniswap_v2",
    f"""WITH {LOGS_SQL} SELECT supp AS entity_id, cents AS amount_in, qty AS amount_out,
  '{{"amount0_in":"0","amount1_in":"' || cents || '","amount0_out":"' || qty || '","amount1_out":"0","to":"' || part || '"}}' AS extra FROM logs WHERE kind = 4""",
)
def decode_uniswap_v2(spark, sf):
    rows = _decoded(spark, sf, [4])
    keys = ["amount0_in", "amount1_in", "amount0_out", "amount1_out", "to"]
    return rows.select("entity_id", *_bigint("amount_in", "amount_out"), _json(keys).alias("extra"))


def _json(keys):
    """The properties in a fixed order, for comparing."""
    return F.to_json(F.struct(*[F.get_json_object("extra", f"$.{k}").alias(k) for k in keys]))


@query(
    "decode_uniswap_v3",
    f"""WITH {LOGS_SQL} SELECT supp AS entity_id, cents AS amount_in, qty AS amount_out, 'swap' AS event_type,
  '{{"amount0":"' || -qty || '","amount1":"' || cents || '","recipient":"' || part || '"}}' AS extra FROM logs WHERE kind = 5""",
)
def decode_uniswap_v3(spark, sf):
    rows = _decoded(spark, sf, [5])
    return rows.select(
        "entity_id", *_bigint("amount_in", "amount_out"), "event_type", _json(["amount0", "amount1", "recipient"]).alias("extra")
    )


@query(
    "decode_stargate",
    f"""WITH {LOGS_SQL} SELECT part AS entity_id, cents AS amount_out, qty::VARCHAR AS link_key, 'stargate_dst_chain' AS link_key_type,
  '{{"dst_chain_id":"' || qty || '","to":"' || part || '","qty":"' || cents || '"}}' AS extra FROM logs WHERE kind = 6""",
)
def decode_stargate(spark, sf):
    rows = _decoded(spark, sf, [6])
    return rows.select("entity_id", *_bigint("amount_out"), "link_key", "link_key_type", _json(["dst_chain_id", "to", "qty"]).alias("extra"))


@query(
    "decode_across",
    f"""WITH {LOGS_SQL} SELECT ord AS entity_id, part AS token_in, supp AS token_out, cents AS amount_in, qty AS amount_out, l_partkey::VARCHAR AS link_key,
  l_suppkey::VARCHAR AS destination FROM logs WHERE kind = 7""",
)
def decode_across(spark, sf):
    rows = _decoded(spark, sf, [7])
    return rows.select(
        "entity_id", "token_in", "token_out", *_bigint("amount_in", "amount_out"), "link_key",
        F.get_json_object("extra", "$.destination_chain_id").alias("destination"),
    )


@query(
    "decode_base_eth",
    f"""WITH {LOGS_SQL} SELECT supp AS entity_id, 'ETH' AS token_out, cents AS amount_out, part AS counterparty, ord || ':eth' AS link_key FROM logs WHERE kind = 8""",
)
def decode_base_eth(spark, sf):
    return _decoded(spark, sf, [8]).select("entity_id", "token_out", *_bigint("amount_out"), "counterparty", "link_key")


@query(
    "decode_base_erc20",
    f"""WITH {LOGS_SQL} SELECT ord AS entity_id, supp AS token_out, cents AS amount_out, part AS counterparty, ord || ':erc20' AS link_key,
  part AS remote_token FROM logs WHERE kind = 9""",
)
def decode_base_erc20(spark, sf):
    return _decoded(spark, sf, [9]).select(
        "entity_id", "token_out", *_bigint("amount_out"), "counterparty", "link_key",
        F.get_json_object("extra", "$.remote_token").alias("remote_token"),
    )


@query(
    "decode_batch",
    f"""WITH {LOGS_SQL} SELECT CASE WHEN kind = 0 THEN 'transfer_out' WHEN kind = 1 THEN 'approval' WHEN kind = 2 THEN 'deposit' WHEN kind = 3 THEN 'withdrawal'
    WHEN kind < 6 THEN 'swap' ELSE 'bridge_out' END AS event_type, count(*) AS n, sum(CASE WHEN kind IN (4, 5, 7) THEN qty ELSE cents END)::BIGINT AS amount
FROM logs WHERE kind < 10 GROUP BY 1""",
)
def decode_batch(spark, sf):
    rows = D.decode_logs(logs(spark, sf))
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("amount_out").cast("decimal(28,0)")).cast("bigint").alias("amount")
    )


@query("unknown_topics", f"WITH {LOGS_SQL} SELECT '0x{'99' * 32}' AS topic0, count(*) AS n_logs FROM logs WHERE kind = 10")
def unknown_topics(spark, sf):
    return D.unknown_topics(logs(spark, sf))


def _custom_registry():
    """Two entries share the transfer signature; the approval has one entry, whose pattern never matches."""
    transfer, approval = D.DEFAULT_DECODERS[0], D.DEFAULT_DECODERS[1]
    special, low = replace(transfer, name="Special"), replace(transfer, name="Low")
    return D.DecoderRegistry(
        [
            D.RegistryEntry(special, address_pattern=f"0x{171:040X}"),
            D.RegistryEntry(low, address_pattern=f"0X{'0' * 38}*"),
            D.RegistryEntry(approval, address_pattern="0xdead"),
        ]
    )


@query(
    "registry_lookup",
    f"""WITH {LOGS_SQL} SELECT CASE WHEN kind = 1 THEN 'Approval' WHEN kind = 0 AND l_partkey = 171 THEN 'Special'
    WHEN kind = 0 AND l_partkey < 256 THEN 'Low' END AS decoder, count(*) AS n FROM logs GROUP BY 1""",
)
def registry_lookup(spark, sf):
    return logs(spark, sf).groupBy(_custom_registry().lookup().alias("decoder")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "registry_listing",
    f"""WITH {LOGS_SQL}, c AS (SELECT kind, count(*) AS n_logs FROM logs GROUP BY 1), t(kind, event_name, protocol) AS (VALUES
  {', '.join(f"({i}, '{d.name}', '{d.protocol}')" for i, d in enumerate(D.DEFAULT_DECODERS))})
SELECT event_name, protocol, '1' AS version, '*' AS chain, '*' AS address_pattern, n_logs FROM t LEFT JOIN c USING (kind)""",
)
def registry_listing(spark, sf):
    counts = logs(spark, sf).groupBy("topic0").agg(F.count(F.lit(1)).alias("n_logs"))
    listing = D.default_registry().frame(spark).join(counts, "topic0", "left")
    return listing.select("event_name", "protocol", "version", "chain", "address_pattern", "n_logs")


@query(
    "wide_integers",
    """SELECT o_orderkey, CAST((CAST(o_custkey * 1000003 AS UHUGEINT) * 18446744073709551616 + CAST(o_orderkey * 7919 AS UHUGEINT)) AS VARCHAR) AS digits FROM orders""",
)
def wide_integers(spark, sf):
    high, low = (F.lpad(F.lower(F.hex(c)), 16, "0") for c in (F.col("o_custkey") * 1000003, F.col("o_orderkey") * 7919))
    words = load(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("0" * 32), high, low).alias("word"))
    return H.with_digits(words, {"digits": "word"}).select("o_orderkey", "digits")


@query(
    "internal_swaps",
    """WITH e AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'N' THEN 'transfer_out' ELSE 'swap' END AS et,
    l_linenumber = 1 AND l_returnflag = 'A' AS agg FROM lineitem),
a AS (SELECT l_orderkey, max(agg) AS has FROM e GROUP BY 1)
SELECT CASE WHEN et = 'swap' AND NOT agg AND has THEN 'swap_internal' ELSE et END AS event_type, count(*) AS n FROM e JOIN a USING (l_orderkey) GROUP BY 1""",
)
def internal_swaps(spark, sf):
    events = load(spark, sf, "lineitem").select(
        F.lit("base").alias("chain"), F.col("l_orderkey").cast("string").alias("tx_hash"),
        F.when(F.col("l_returnflag") == "N", "transfer_out").otherwise("swap").alias("event_type"),
        F.when((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "A"), "1inch").otherwise("").alias("aggregator"),
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey").alias("event_id"),
    )
    return D.mark_internal_swaps(events).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))

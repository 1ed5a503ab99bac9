"""Token metadata, prices and USD values, with parts as tokens."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wayline.functions.scalars import is_stablecoin
from wayline.operators import enrich as E
from wayline.operators import links as L
from wayline.schema import CANONICAL_EVENTS, TOKEN_METADATA, TOKEN_PRICES, conform
from wayline.session import derived_table
from wayline.sinks import tables
from wayline.sources import prices as P
from wayline.sources import tokens as TK
from workload.registry import query
from workload.standins import INS_SQL, LINE_HASH_SQL, LINKS_SQL, OUTS_SQL
from workload.standins import line_hash, lineitem_ins, load, order_outs

USDC = "0xA0b86991c6218b36c1d19d4a2e9eb0ce3606eb48"
# parts are quoted and traded a few times a year
BUCKET = {"bucket": timedelta(days=90)}
START, END = datetime(1993, 1, 1), datetime(1999, 12, 31)


def trades(spark, sf):
    """Line items as events: a part comes in and, for some suppliers, dollars go out."""
    paid = F.col("l_suppkey") % 3 == 0
    cents = F.round(F.col("l_extendedprice") * 100).cast("decimal(38,0)")
    rows = load(spark, sf, "lineitem").select(
        F.concat(F.lit("s:"), "l_suppkey").alias("entity_id"),
        F.lit("wallet").alias("entity_type"),
        line_hash().alias("event_id"),
        F.lit("swap").alias("event_type"),
        F.lit("transaction").alias("event_category"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.lit("ethereum").alias("chain"),
        F.concat(F.lit("p"), "l_partkey").alias("token_in"),
        F.round("l_quantity").cast("decimal(38,0)").alias("amount_in"),
        F.when(paid, F.lit(USDC)).alias("token_out"),
        F.when(paid, cents).alias("amount_out"),
        F.when(F.col("l_returnflag") == "R", F.lit(1)).cast("decimal(38,6)").alias("amount_in_usd"),
    )
    return conform(rows, CANONICAL_EVENTS)


def _trades(spark, sf):
    """Trades whose ids travel as bytes, a hash in half the room of its hex digits."""
    return trades(spark, sf).withColumn("event_id", F.unhex("event_id"))


def _text_id():
    return F.lower(F.hex("event_id")).alias("event_id")


def quotes(spark, sf):
    return derived_table(spark, f"{sf}/quotes", lambda: _quotes(spark, sf))


def _quotes(spark, sf):
    """Price of a part on the day it was ordered."""
    orders = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("timestamp"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("decimal(18,0)")
    rows = (
        load(spark, sf, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.concat(F.lit("p"), "l_partkey").alias("token_address"),
            F.lit("ethereum").alias("chain"),
            "timestamp",
            (cents * F.lit("0.01").cast("decimal(3,2)")).alias("price_usd"),
            F.lit("orders").alias("source"),
            (F.col("timestamp") + F.make_interval(hours=F.col("l_linenumber"))).alias("inserted_at"),
        )
    )
    return conform(rows, TOKEN_PRICES)


def part_metadata(spark, sf):
    """Two versions of each part; small parts are unknown tokens."""
    part = load(spark, sf, "part").where("p_size > 5")
    versions = F.array(
        F.struct(F.lit(datetime(2020, 1, 1)).alias("inserted_at"), F.lit(9).alias("decimals")),
        F.struct(F.lit(datetime(2021, 1, 1)).alias("inserted_at"), (F.col("p_size") % 4).alias("decimals")),
    )
    rows = part.select("p_partkey", "p_name", "p_brand", F.explode(versions).alias("v")).select(
        F.concat(F.lit("p"), "p_partkey").alias("token_address"),
        F.lit("ethereum").alias("chain"),
        F.upper("p_brand").alias("symbol"),
        F.col("v.decimals").alias("decimals"),
        F.col("p_name").alias("name"),
        F.col("v.inserted_at").cast("timestamp").alias("inserted_at"),
    )
    return conform(rows, TOKEN_METADATA)


TRADES_SQL = f"""
tr AS (SELECT {LINE_HASH_SQL} AS event_id, l_shipdate AS ts, 'p' || l_partkey AS token_in, CAST(round(l_quantity) AS BIGINT) AS qty,
         CASE WHEN l_suppkey % 3 = 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) END AS cents, l_returnflag = 'R' AS done
       FROM lineitem),
q0 AS (SELECT 'p' || l_partkey AS token, o_orderdate AS ts, l_linenumber AS ver, CAST(round(l_extendedprice * 100) AS BIGINT) AS price
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
q AS (SELECT token, ts, arg_max(price, (ver, price)) AS price FROM q0 GROUP BY 1, 2),
m AS (SELECT 'p' || p_partkey AS token, p_size % 4 AS decimals FROM part WHERE p_size > 5),
pend AS (SELECT * FROM tr WHERE NOT done AND ts BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '1999-12-31'),
priced AS (SELECT t.*, m.decimals, q.price, q.ts AS price_ts,
             CASE WHEN m.decimals IS NOT NULL THEN CAST(t.qty * q.price AS DOUBLE) / (100 * power(10, m.decimals)) END AS in_usd,
             CAST(t.cents AS DOUBLE) / 1000000 AS out_usd
           FROM pend t LEFT JOIN m ON m.token = t.token_in ASOF LEFT JOIN q ON q.token = t.token_in AND t.ts >= q.ts),
upd AS (SELECT * FROM priced WHERE in_usd IS NOT NULL OR out_usd IS NOT NULL)"""


@query("events_to_price", f"WITH {TRADES_SQL} SELECT event_id, qty AS amount_in, cents AS amount_out FROM pend")
def events_to_price(spark, sf):
    rows = E.pending_events(trades(spark, sf), START, END)
    return rows.select("event_id", *[F.col(c).cast("bigint").alias(c) for c in ("amount_in", "amount_out")])


@query(
    "metadata_join",
    f"WITH {TRADES_SQL} SELECT event_id, decimals AS decimals_in, NULL::INTEGER AS decimals_out FROM tr LEFT JOIN m ON m.token = token_in",
)
def metadata_join(spark, sf):
    rows = E.with_metadata(_trades(spark, sf), part_metadata(spark, sf))
    return rows.select(_text_id(), "decimals_in", "decimals_out")


@query(
    "price_asof",
    f"""WITH {TRADES_SQL} SELECT event_id, price_ts, price / 100.0::DOUBLE AS price_usd FROM priced WHERE decimals IS NOT NULL""",
)
def price_asof(spark, sf):
    legs = E.token_legs(E.pending_events(_trades(spark, sf), START, END)).where(F.col("side") == "in")
    priced = E.price_legs(legs, part_metadata(spark, sf), quotes(spark, sf), **BUCKET)
    return priced.where(F.col("decimals").isNotNull()).select(
        _text_id(), "price_ts", F.col("price_usd").cast("double").alias("price_usd")
    )


UPDATES = f"WITH {TRADES_SQL} SELECT event_id, in_usd AS amount_in_usd, out_usd AS amount_out_usd FROM upd"


def _doubles(df):
    return df.select(_text_id(), *[F.col(c).cast("double").alias(c) for c in ("amount_in_usd", "amount_out_usd")])


def updates(spark, sf):
    pending = E.pending_events(_trades(spark, sf), START, END)
    return E.enrichment_updates(pending, part_metadata(spark, sf), quotes(spark, sf), **BUCKET)


@query("usd_updates", UPDATES)
def usd_updates(spark, sf):
    return _doubles(updates(spark, sf))


@query(
    "usd_trailing_window",
    f"""WITH {TRADES_SQL} SELECT event_id, in_usd AS amount_in_usd, out_usd AS amount_out_usd FROM upd
WHERE ts BETWEEN TIMESTAMP '1996-12-01' AND TIMESTAMP '1996-12-31'""",
)
def usd_trailing_window(spark, sf):
    return _doubles(
        E.enrich_window(
            _trades(spark, sf), part_metadata(spark, sf), quotes(spark, sf), end=datetime(1996, 12, 31), window=timedelta(days=30)
        )
    )


APPLIED_SQL = f"""WITH {TRADES_SQL}, ap AS (
  SELECT tr.event_id, tr.ts, coalesce(upd.in_usd, CASE WHEN tr.done THEN 1.0::DOUBLE END) AS amount_in_usd, upd.out_usd AS amount_out_usd
  FROM tr LEFT JOIN upd USING (event_id))"""


@query("updates_applied", f"{APPLIED_SQL} SELECT event_id, amount_in_usd, amount_out_usd FROM ap")
def updates_applied(spark, sf):
    return _doubles(E.apply_updates(_trades(spark, sf), updates(spark, sf)))


@query(
    "updated_months",
    f"WITH {TRADES_SQL} SELECT DISTINCT CAST(date_trunc('month', ts) AS VARCHAR)[1:10] AS event_month FROM upd",
)
def updated_months(spark, sf):
    months = E.affected_months(_trades(spark, sf), updates(spark, sf))
    return months.select(F.col("event_month").cast("string").alias("event_month"))


@query(
    "usd_coverage",
    f"""{APPLIED_SQL} SELECT count(*) AS total, count(amount_in_usd) AS enriched, count(*) - count(amount_in_usd) AS pending,
  round(count(amount_in_usd) / count(*)::DOUBLE, 4) AS rate FROM ap WHERE ts BETWEEN TIMESTAMP '1996-06-01' AND TIMESTAMP '1998-06-01'""",
)
def usd_coverage(spark, sf):
    filled = E.apply_updates(_trades(spark, sf), updates(spark, sf))
    return E.coverage(filled, end=datetime(1998, 6, 1), window=datetime(1998, 6, 1) - datetime(1996, 6, 1))


@query(
    "stablecoin_flags",
    f"WITH {TRADES_SQL} SELECT event_id, cents IS NOT NULL AS is_stable FROM tr",
)
def stablecoin_flags(spark, sf):
    return trades(spark, sf).select("event_id", is_stablecoin(F.col("token_out")).alias("is_stable"))


@query(
    "links_usd",
    f"""WITH {OUTS_SQL}, {INS_SQL}, {LINKS_SQL},
q AS (SELECT o_orderpriority AS token, o_orderdate AS ts, max(o_orderkey % 1000) AS price FROM orders GROUP BY 1, 2)
SELECT event_id AS src_event_id, CAST(amount AS DOUBLE) * q.price / 100 AS amount_usd
FROM (SELECT * FROM links WHERE dst_event_id IS NOT NULL) l ASOF LEFT JOIN q ON q.token = l.link_key_type AND l."timestamp" >= q.ts""",
)
def links_usd(spark, sf):
    outs = order_outs(spark, sf).withColumn("token_out", F.col("link_key_type"))
    matched = L.match(outs, lineitem_ins(spark, sf))
    prices = load(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("token_address"), F.lit("sales").alias("chain"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"), (F.col("o_orderkey") % 1000).alias("price_usd"),
    )
    metadata = outs.select(F.col("token_out").alias("token_address"), "chain").distinct()
    metadata = conform(metadata.withColumn("decimals", F.lit(2)), TOKEN_METADATA)
    rows = E.link_usd(matched, metadata, conform(prices, TOKEN_PRICES), bucket=timedelta(days=1))
    return rows.select("src_event_id", F.col("amount_usd").cast("double").alias("amount_usd"))


def price_payloads(spark, sf):
    """One landed payload per order with the quotes of its parts, as the price API returns them."""
    per_part = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(
        F.max(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"),
        F.max("l_linenumber").alias("line"),
    )
    quote = F.struct(
        F.when(F.col("line") != 7, F.col("cents")).alias("usd"),
        F.when(F.col("line") < 4, F.col("line")).alias("usd_24h_vol"),
    )
    # an order has a few lines, so its map is small
    bodies = per_part.groupBy("l_orderkey").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("0xp"), "l_partkey").alias("k"), quote.alias("v")))).alias("m")
    )
    chains = F.when(F.col("o_orderpriority") == "1-URGENT", "ethereum").when(F.col("o_orderpriority") == "5-LOW", "unknown").otherwise("base")
    return load(spark, sf, "orders").join(bodies, F.col("o_orderkey") == F.col("l_orderkey")).select(
        chains.alias("chain"), F.col("o_orderdate").cast("timestamp").alias("landed_at"), F.to_json("m").alias("body")
    )


def requested_tokens(spark, sf):
    return load(spark, sf, "part").select(
        F.explode(F.array(F.lit("ethereum"), F.lit("base"), F.lit("unknown"))).alias("chain"),
        F.concat(F.lit("0xP"), "p_partkey").alias("token_address"),
    )


PRICES_SQL = """
pl AS (SELECT l_orderkey, l_partkey, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, max(l_linenumber) AS line FROM lineitem GROUP BY 1, 2),
pr AS (SELECT '0xP' || l_partkey AS token_address, CASE o_orderpriority WHEN '1-URGENT' THEN 'ethereum' ELSE 'base' END AS chain,
         o_orderdate AS "timestamp", CAST(cents AS DOUBLE) AS price_usd, CASE WHEN line < 4 THEN line END::DOUBLE AS volume_24h_usd
       FROM pl JOIN orders ON o_orderkey = l_orderkey WHERE line <> 7 AND o_orderpriority <> '5-LOW')"""


@query("price_rows", f"WITH {PRICES_SQL} SELECT *, 'coingecko' AS source FROM pr")
def price_rows(spark, sf):
    rows = P.price_rows(price_payloads(spark, sf), requested_tokens(spark, sf)).drop("inserted_at")
    return rows.withColumns({c: F.col(c).cast("double") for c in ("price_usd", "volume_24h_usd")})


@query("price_load_counts", f"WITH {PRICES_SQL} SELECT chain, count(*) AS n_prices FROM pr GROUP BY 1")
def price_load_counts(spark, sf):
    return P.count_by_chain(P.price_rows(price_payloads(spark, sf), requested_tokens(spark, sf)))


@query(
    "price_table_rows",
    f"""WITH {PRICES_SQL} SELECT token_address, "timestamp", price_usd, TIMESTAMP '2024-01-01' AS inserted_at FROM pr""",
)
def price_table_rows(spark, sf):
    rows = P.price_rows(price_payloads(spark, sf), requested_tokens(spark, sf))
    rows = tables.price_table_rows(rows, datetime(2024, 1, 1))
    return rows.select("token_address", "timestamp", F.col("price_usd").cast("double").alias("price_usd"), "inserted_at")


@query(
    "contract_info",
    """SELECT '0x' || p_partkey AS token_address, CASE WHEN p_size % 2 = 0 THEN 'arbitrum' ELSE 'base' END AS chain, upper(p_brand) AS symbol,
  CASE WHEN p_size % 2 = 0 THEN p_size ELSE 18 END AS decimals, p_name AS name FROM part WHERE p_size % 5 <> 0""",
)
def contract_info(spark, sf):
    chain = (
        F.when(F.col("p_size") % 5 == 0, "elsewhere").when(F.col("p_size") % 2 == 0, "arbitrum").otherwise("base")
    )
    body = F.struct(
        F.lower("p_brand").alias("symbol"),
        F.col("p_name").alias("name"),
        F.create_map(F.lit("arbitrum-one"), F.struct(F.col("p_size").alias("decimal_place"))).alias("detail_platforms"),
    )
    landed = load(spark, sf, "part").select(
        chain.alias("chain"), F.concat(F.lit("0x"), "p_partkey").alias("address"),
        F.lit(datetime(2024, 1, 1)).alias("landed_at"), F.to_json(body).alias("body"),
    )
    return TK.contract_info(landed).drop("inserted_at")


@query(
    "latest_metadata",
    """SELECT 'p' || p_partkey AS token_address, upper(p_brand) AS symbol, p_size % 4 AS decimals, p_name AS name,
  TIMESTAMP '2021-01-01' AS inserted_at FROM part WHERE p_size > 5""",
)
def latest_metadata(spark, sf):
    return TK.latest_metadata(part_metadata(spark, sf)).drop("chain")


@query(
    "known_tokens",
    f"""WITH t(i, token, chain, symbol) AS (VALUES {', '.join(f"({i}, '{t[0]}', '{t[1]}', '{t[2]}')" for i, t in enumerate(TK.KNOWN_TOKENS))})
SELECT t.chain, t.symbol, count(*) AS n_lines, sum(CAST(round(l_quantity) AS BIGINT))::BIGINT AS quantity
FROM lineitem JOIN t ON t.i = l_partkey % 14 GROUP BY 1, 2""",
)
def known_tokens(spark, sf):
    addresses = F.array(*[F.struct(F.lit(t[1]).alias("chain"), F.lit(t[0]).alias("token_address")) for t in TK.KNOWN_TOKENS])
    lines = load(spark, sf, "lineitem").select(
        F.get(addresses, (F.col("l_partkey") % 14).cast("int")).alias("t"), F.round("l_quantity").cast("bigint").alias("q")
    )
    return (
        lines.select("t.*", "q")
        .join(TK.known_tokens(spark), ["chain", "token_address"])
        .groupBy("chain", "symbol")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("q").alias("quantity"))
    )


@query(
    "contract_labels",
    """SELECT l_partkey AS part, p_brand AS contract_label, p_type AS contract_category, count(*) AS n
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey GROUP BY 1, 2, 3""",
)
def contract_labels(spark, sf):
    labels = load(spark, sf, "part").where("p_size > 10").select(
        F.lit("ethereum").alias("chain"), F.concat(F.lit("P"), "p_partkey").alias("address"),
        F.col("p_brand").alias("label"), F.col("p_type").alias("category"),
    )
    events = trades(spark, sf).withColumn("venue", F.col("token_in"))
    return (
        TK.label_addresses(events, labels)
        .groupBy(F.substring("venue", 2, 20).cast("bigint").alias("part"), "contract_label", "contract_category")
        .agg(F.count(F.lit(1)).alias("n"))
    )

"""Attribution, scoring, health signals and the streaming forms of ingest."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wayline.plans import attribution as A
from wayline.plans import health as HL
from wayline.plans import holdings as HO
from wayline.plans import scoring as S
from wayline.schema import CANONICAL_EVENTS, ENTITY_RELATIONSHIPS, conform
from wayline.session import shared_folder
from wayline.streaming import jobs
from wayline.streaming.continuous_links import STATE_STORE, match_continuous
from workload.registry import query
from workload.standins import INS_SQL, OUTS_SQL, lineitem_ins, load, order_outs

START, END = datetime(2024, 1, 3), datetime(2024, 1, 27)


def campaign_events(spark, sf):
    """Sign-ups as web sessions of a device, clicks and purchases as transfers and swaps of a wallet."""
    kind = (
        F.when(F.col("event_type") == "signup", "session_start")
        .when(F.col("event_type") == "click", "bridge_out")
        .when(F.col("event_type") == "purchase", "swap")
    )
    web = kind == "session_start"
    source = F.when(F.col("user_id") % 3 == 0, "x").when(F.col("user_id") % 3 == 1, "news")
    utm = F.struct(
        source.alias("utm_source"),
        F.when(F.col("event_id") % 2 == 0, "paid").alias("utm_medium"),
        F.when(F.col("event_id") % 5 == 0, "launch").alias("utm_campaign"),
    )
    rows = load(spark, sf, "events").where(kind.isNotNull()).select(
        F.concat(F.when(web, "d").otherwise("w"), "user_id").alias("entity_id"),
        F.when(web, "device_id").otherwise("wallet").alias("entity_type"),
        F.col("event_id").cast("string").alias("event_id"),
        kind.alias("event_type"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(~web, F.col("value").cast("decimal(38,6)")).alias("amount_out_usd"),
        F.when(web, F.to_json(utm)).alias("extra"),
    )
    return conform(rows, CANONICAL_EVENTS)


def device_links(spark, sf):
    """Each device is linked to its user's wallet, a quarter of them too weakly to count."""
    rows = load(spark, sf, "events").select("user_id").distinct().select(
        F.concat(F.lit("d"), "user_id").alias("from_entity"),
        F.lit("device_id").alias("from_entity_type"),
        F.concat(F.lit("w"), "user_id").alias("to_entity"),
        F.lit("wallet").alias("to_entity_type"),
        F.lit("linked_via_signup").alias("relationship_type"),
        F.when(F.col("user_id") % 4 != 0, 0.95).otherwise(0.3).alias("confidence_score"),
        F.lit("app").alias("source"),
    )
    return conform(rows, ENTITY_RELATIONSHIPS)


TOUCH_SQL = """
ses AS (SELECT event_id, ts, user_id, CASE WHEN user_id % 4 <> 0 THEN user_id END AS wallet,
    CASE WHEN event_id % 5 = 0 THEN 'launch' WHEN user_id % 3 = 2 AND event_id % 2 = 1 THEN '(direct)' ELSE
      CASE user_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'news' ELSE '(none)' END || '/' || CASE WHEN event_id % 2 = 0 THEN 'paid' ELSE '(none)' END END AS campaign_id,
    CASE WHEN event_id % 2 = 0 THEN 'paid' ELSE CASE user_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'news' ELSE 'direct' END END AS channel
  FROM events WHERE event_type = 'signup' AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-27'),
conv AS (SELECT event_id, ts, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE event_type IN ('click', 'purchase')),
linked AS (SELECT * FROM ses WHERE wallet IS NOT NULL),
touch AS (SELECT conv.*, s.event_id AS session_id, s.campaign_id, s.channel, s.ts AS session_ts
          FROM conv ASOF LEFT JOIN linked s ON s.wallet = conv.user_id AND conv.ts >= s.ts)"""
ATTRIBUTION_SQL = """{touch},
r AS (SELECT {by}, {first}count(*) AS sessions, count(DISTINCT wallet) AS wallet_connects FROM ses GROUP BY {by}),
o AS (SELECT {by}, count(*) FILTER (event_type = 'click') AS bridges, count(*) FILTER (event_type = 'purchase') AS swaps, sum(cents)::BIGINT AS cents
      FROM touch WHERE session_id IS NOT NULL GROUP BY {by})
SELECT r.*, coalesce(bridges, 0) AS bridges, coalesce(swaps, 0) AS swaps, coalesce(cents, 0) / 100.0::DOUBLE AS total_onchain_value_usd{cost}
FROM r LEFT JOIN o USING ({by})"""


def _shown(result):
    return result.withColumn("total_onchain_value_usd", F.col("total_onchain_value_usd").cast("double"))


@query(
    "campaign_attribution",
    "WITH "
    + ATTRIBUTION_SQL.format(
        touch=TOUCH_SQL, by="campaign_id", first="min(channel) AS channel, ",
        cost=", CASE WHEN campaign_id = 'launch' AND swaps > 0 THEN 1000.0::DOUBLE / swaps END AS cac_per_swap",
    ),
)
def campaign_attribution(spark, sf):
    spend = load(spark, sf, "region").where("r_regionkey = 0").select(
        F.lit("launch").alias("campaign_id"), F.lit(1000.0).alias("spend_usd")
    )
    return _shown(A.attribute(campaign_events(spark, sf), device_links(spark, sf), START, END, spend=spend))


@query(
    "campaign_result",
    "WITH res AS (WITH "
    + ATTRIBUTION_SQL.format(touch=TOUCH_SQL, by="campaign_id", first="min(channel) AS channel, ", cost="")
    + ") SELECT campaign_id, campaign_id AS campaign_name, channel, sessions, bridges, swaps FROM res WHERE campaign_id = 'launch'",
)
def campaign_result(spark, sf):
    rows = A.attribute_campaign(campaign_events(spark, sf), device_links(spark, sf), "launch", START, END)
    return rows.select("campaign_id", "campaign_name", "channel", "sessions", "bridges", "swaps")


@query(
    "channel_comparison",
    "WITH " + ATTRIBUTION_SQL.format(touch=TOUCH_SQL, by="channel", first="", cost=""),
)
def channel_comparison(spark, sf):
    rows = A.compare_channels(campaign_events(spark, sf), device_links(spark, sf), START, END)
    return _shown(rows).drop("cac_per_swap")


@query(
    "last_touch",
    f"""WITH {TOUCH_SQL} SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN ts <= session_ts + INTERVAL 2 DAY THEN campaign_id END AS campaign_id,
  CASE WHEN ts <= session_ts + INTERVAL 2 DAY THEN session_ts END AS session_ts FROM touch""",
)
def last_touch(spark, sf):
    events = campaign_events(spark, sf)
    sessions = A.campaign_sessions(events, device_links(spark, sf), START, END)
    conversions = events.where(F.col("entity_type") == "wallet")
    return A.last_touch(conversions, sessions, timedelta(days=2)).select("event_id", "campaign_id", "session_ts")


SCORE_SQL = f"""WITH {OUTS_SQL}, {INS_SQL},
ev AS (SELECT entity_id, chain, protocol, 'bridge_out' AS et, amount, "timestamp" FROM outs
       UNION ALL SELECT entity_id, chain, protocol, 'bridge_in', NULL, "timestamp" FROM ins),
f AS (SELECT entity_id, count(*) FILTER (et = 'bridge_out') AS bridges, count(*) FILTER (et = 'bridge_in') AS swaps, count(DISTINCT chain) AS chains,
        coalesce(sum(amount), 0)::BIGINT AS cents FROM ev GROUP BY 1),
sh AS (SELECT *, least(cents / 100.0::DOUBLE / 1000000.0::DOUBLE, 1.0::DOUBLE) AS v, least(bridges / 10.0::DOUBLE, 1.0::DOUBLE) AS b,
         least(chains / 4.0::DOUBLE, 1.0::DOUBLE) AS c, least(swaps / 20.0::DOUBLE, 1.0::DOUBLE) AS s FROM f),
tp AS (SELECT entity_id, string_agg(protocol, ',' ORDER BY rn) AS top_protocols FROM (
         SELECT entity_id, protocol, row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, protocol) AS rn FROM ev GROUP BY 1, 2)
       WHERE rn <= 2 GROUP BY 1),
tc AS (SELECT DISTINCT entity_id, chain AS top_chains FROM ev),
scored AS (SELECT entity_id AS wallet_address, round(v * 40.0::DOUBLE + b * 25.0::DOUBLE + c * 15.0::DOUBLE + s * 20.0::DOUBLE, 4) AS score,
  concat_ws(',', CASE WHEN v >= 0.5 THEN 'volume' END, CASE WHEN b >= 0.5 THEN 'bridges' END, CASE WHEN c >= 0.5 THEN 'chains' END,
    CASE WHEN s >= 0.5 THEN 'swaps' END) AS signals, top_chains, top_protocols, cents / 100.0::DOUBLE AS estimated_volume_usd
  FROM sh JOIN tp USING (entity_id) JOIN tc USING (entity_id))"""
SCORE_OPTIONS = {"full": {"volume": 1_000_000.0, "bridges": 10.0, "chains": 4.0, "swaps": 20.0}, "swap": "bridge_in", "top": 2}


def _scores(scored):
    return scored.withColumns(
        {
            **{c: F.array_join(c, ",") for c in ("signals", "top_chains", "top_protocols")},
            "estimated_volume_usd": F.col("estimated_volume_usd").cast("double"),
        }
    )


@query("wallet_scores", f"{SCORE_SQL} SELECT * FROM scored")
def wallet_scores(spark, sf):
    events = order_outs(spark, sf).unionByName(lineitem_ins(spark, sf))
    return _scores(S.score_wallets(events, **SCORE_OPTIONS))


@query(
    "wallet_segment",
    f"""{SCORE_SQL}, act AS (SELECT entity_id FROM outs WHERE "timestamp" >= TIMESTAMP '1996-01-01' GROUP BY 1 HAVING sum(amount) > 30000000)
SELECT scored.* FROM scored JOIN act ON act.entity_id = wallet_address
WHERE wallet_address IN (SELECT 'c:' || c_custkey FROM customer WHERE c_acctbal > 0)
  AND wallet_address NOT IN (SELECT 'c:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def wallet_segment(spark, sf):
    events = order_outs(spark, sf).unionByName(lineitem_ins(spark, sf))
    customer = load(spark, sf, "customer").withColumn("entity_id", F.concat(F.lit("c:"), "c_custkey"))
    rows = S.segment(
        events, chain="sales", min_usd=300_000, since=datetime(1996, 1, 1),
        interacted=customer.where("c_mktsegment = 'BUILDING'"), holders=customer.where("c_acctbal > 0"), **SCORE_OPTIONS,
    )
    return _scores(rows)


MOVES_SQL = """m AS (
  SELECT 'c:' || o_custkey AS giver, 's:' || l_suppkey AS taker, CAST(l_partkey % 3 AS VARCHAR) AS token,
    CAST(round(l_extendedprice * 100) AS HUGEINT) AS high, l_orderkey::HUGEINT AS low, l_shipdate AS ts
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate <= TIMESTAMP '2000-06-30'),
b AS (
  SELECT token, giver AS entity_id, '-' AS sign, sum(high) AS high, sum(low) AS low, count(*) AS n FROM m GROUP BY ALL
  UNION ALL SELECT token, taker, '', sum(high), sum(low), count(*) FROM m GROUP BY ALL),
held AS (SELECT token AS token_address, entity_id, sign || high || lpad(CAST(low AS VARCHAR), 50, '0') AS balance, n AS n_transfers FROM b)"""


def _moves(spark, sf):
    """Line items as transfers from customer to supplier; amounts have some 60 digits."""
    l, o = load(spark, sf, "lineitem"), load(spark, sf, "orders")
    rows = l.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    high = F.round(F.col("l_extendedprice") * 100).cast("decimal(18,0)").cast("string")
    return rows.select(
        F.lit("sales").alias("chain"), F.concat(F.lit("c:"), "o_custkey").alias("entity_id"), F.concat(F.lit("s:"), "l_suppkey").alias("counterparty"),
        (F.col("l_partkey") % 3).cast("string").alias("token_out"), F.concat(high, F.lpad(F.col("l_orderkey").cast("string"), 50, "0")).alias("amount_out_raw"),
        F.lit(None).cast("decimal(38,0)").alias("amount_out"), F.col("l_shipdate").cast("timestamp").alias("timestamp"),
    )


@query("token_balances", f"WITH {MOVES_SQL} SELECT token_address, entity_id, balance, n_transfers FROM held")
def token_balances(spark, sf):
    return HO.balances(_moves(spark, sf), as_of=datetime(2000, 6, 30)).drop("chain")


@query("token_holders", f"WITH {MOVES_SQL} SELECT entity_id, balance FROM held WHERE token_address = '1' AND sign = '' AND high >= 5000000".replace("lpad(CAST(low AS VARCHAR), 50, '0') AS balance", "lpad(CAST(low AS VARCHAR), 50, '0') AS balance, sign, high"))
def token_holders(spark, sf):
    return HO.holders(_moves(spark, sf), "1", at_least=5_000_000 * 10**50, as_of=datetime(2000, 6, 30)).select("entity_id", "balance")


@query(
    "outreach_conversions",
    """WITH o AS (SELECT c_custkey, TIMESTAMP '1998-06-01' + to_days(c_nationkey::INTEGER) AS ts FROM customer)
SELECT c_custkey AS outreach_id, 'c:' || c_custkey AS entity_id, o.ts AS outreach_ts, CASE WHEN min(o_orderdate) IS NULL THEN 'contacted' ELSE 'converted' END AS status,
  min(o_orderdate) AS converted_at FROM o LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= o.ts GROUP BY 1, 2, 3""",
)
def outreach_conversions(spark, sf):
    outreach = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("outreach_id"),
        F.concat(F.lit("c:"), "c_custkey").alias("entity_id"),
        (F.lit(datetime(1998, 6, 1)) + F.make_interval(days=F.col("c_nationkey"))).alias("outreach_ts"),
        F.lit("contacted").alias("status"),
    )
    return S.outreach_conversions(outreach, order_outs(spark, sf), "bridge_out")


AS_OF = datetime(1999, 1, 15)


def integrator_events(spark, sf):
    """Line items as the traffic of a supplier's customers up to a day."""
    kind = F.when(F.col("l_returnflag") == "A", "bridge_out").when(F.col("l_returnflag") == "R", "error").otherwise("swap")
    rows = load(spark, sf, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("integrator_id"),
        F.concat(F.lit("p"), "l_partkey").alias("entity_id"),
        kind.alias("event_type"), F.col("l_linestatus").alias("chain"), F.col("l_shipdate").cast("timestamp").alias("timestamp"),
    )
    return rows.where(F.col("timestamp") <= F.lit(AS_OF))


def integrators(spark, sf):
    return load(spark, sf, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("integrator_id"),
        F.concat(F.lit("1."), F.col("s_suppkey") % 12, F.lit(".0")).alias("sdk_version"),
        F.when(F.col("s_nationkey") % 2 == 0, "standard").otherwise("premium").alias("tier"),
        F.lit(datetime(1999, 1, 5)).alias("signed_up_at"),
        F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("F"), F.lit("O"))).otherwise(F.array(F.lit("F"))).alias("supported_chains"),
    )


@query(
    "health_signals",
    """WITH ev AS (SELECT 's' || l_suppkey AS id, l_partkey AS u, l_returnflag AS flag, l_linestatus AS chain, l_shipdate AS ts FROM lineitem
  WHERE l_shipdate <= TIMESTAMP '1999-01-15'),
pu AS (SELECT id, u, count(*) AS n, count(*) FILTER (flag = 'A') AS b, count(*) FILTER (flag = 'R') AS e, max(ts) AS last_ts FROM ev GROUP BY 1, 2),
us AS (SELECT id, count(*) FILTER (b > 0 AND b = n) AS bo, count(*) FILTER (b > 0) AS bu, sum(n) AS n, sum(e) AS e, max(last_ts) AS last_ts FROM pu GROUP BY 1),
ch AS (SELECT id, count(*) FILTER (chain <> 'F') AS other FROM (SELECT DISTINCT id, chain FROM ev) GROUP BY 1),
wk AS (SELECT id, date_trunc('week', ts) AS w, count(*) AS n FROM ev GROUP BY 1, 2),
d AS (SELECT id, w, n, coalesce(n < lag(n) OVER (PARTITION BY id ORDER BY w), false) AS dec FROM wk),
st AS (SELECT id, count(*) FILTER (NOT broken) AS streak, arg_max(n, w) AS last_n FROM (
        SELECT *, bool_or(NOT dec) OVER (PARTITION BY id ORDER BY w DESC) AS broken FROM d) GROUP BY 1),
m AS (SELECT 's' || s_suppkey AS id, s_suppkey, s_nationkey % 2 = 0 AS standard, us.*, ch.other, st.streak, st.last_n
      FROM supplier LEFT JOIN us ON us.id = 's' || s_suppkey LEFT JOIN ch ON ch.id = us.id LEFT JOIN st ON st.id = us.id),
sig AS (
  SELECT s_suppkey, 'high_bridge_only_ratio' AS heuristic_name, 'warning' AS severity FROM m WHERE bu > 0 AND bo / bu::DOUBLE >= 0.4
  UNION ALL SELECT s_suppkey, 'outdated_sdk', 'warning' FROM m WHERE s_suppkey % 12 < 10
  UNION ALL SELECT s_suppkey, 'high_error_rate', 'critical' FROM m WHERE e / n::DOUBLE >= 0.34
  UNION ALL SELECT s_suppkey, 'stalled_onboarding', 'warning' FROM m
    WHERE date_diff('day', coalesce(last_ts, TIMESTAMP '1999-01-05'), TIMESTAMP '1999-01-15') >= 7
  UNION ALL SELECT s_suppkey, 'churn_imminent', 'critical' FROM m WHERE streak >= 2
  UNION ALL SELECT s_suppkey, 'ready_for_upgrade', 'info' FROM m WHERE last_n >= 2 AND standard
  UNION ALL SELECT s_suppkey, 'multi_chain_opportunity', 'info' FROM m WHERE other > 0 AND s_suppkey % 3 <> 0)
SELECT 's' || s_suppkey AS integrator_id, heuristic_name, severity, TIMESTAMP '1999-01-15' AS detected_at FROM sig""",
)
def health_signals(spark, sf):
    limits = HL.Thresholds(bridge_only_ratio=0.4, error_rate=0.34, stalled_days=7, declining_weeks=2, upgrade_weekly_events=2)
    signals = HL.evaluate(
        integrator_events(spark, sf), integrators(spark, sf), as_of=AS_OF, latest_sdk="1.10.0", thresholds=limits
    )
    return signals.select("integrator_id", "heuristic_name", "severity", "detected_at")


def _stream(spark, sf, table):
    schema = load(spark, sf, table).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf)


def _run(spark, stream, name):
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    partitions = spark.sparkContext.defaultParallelism
    return jobs.run_available(stream, f"{base}/rows", f"{base}/checkpoint", state_partitions=partitions)


def _event_stream(spark, sf):
    return _stream(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("ts").cast("timestamp").alias("timestamp")
    )


@query("stream_deduplicated", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type FROM events")
def stream_deduplicated(spark, sf):
    # the same landed file is read twice, as after a repeated pull
    twice = _event_stream(spark, sf).unionByName(_event_stream(spark, sf))
    return _run(spark, jobs.deduplicate_stream(twice), "dedup").select("event_id", "event_type")


@query(
    "stream_hourly_counts",
    """SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n_events FROM events
GROUP BY 1, 2 HAVING date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def stream_hourly_counts(spark, sf):
    return _run(spark, jobs.hourly_counts_stream(_event_stream(spark, sf), ["event_type"]), "hourly")


@query(
    "stream_links",
    "SELECT CAST(o_orderkey AS VARCHAR) AS link_key, 'o:' || o_orderkey AS src_event_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)",
)
def stream_links(spark, sf):
    outs = _stream(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("link_key"), F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("c:"), "o_custkey").alias("entity_id"), F.concat(F.lit("o:"), "o_orderkey").alias("event_id"),
    )
    ins = _stream(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("link_key"), F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("s:"), "l_suppkey").alias("entity_id"), F.concat_ws("|", "l_orderkey", "l_linenumber").alias("event_id"),
    )
    links = _run(spark, jobs.match_stream(outs, ins, max_delay=timedelta(days=8000)), "links")
    return links.where(F.col("dst_event_id").isNotNull()).select("link_key", "src_event_id")


@query(
    "stream_links_last_out",
    """WITH o AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderdate::TIMESTAMP AS t FROM orders),
x AS (SELECT CAST(k AS VARCHAR) AS link_key, max_by(id, (t, 'o:' || id)) AS out_id, max(t) AS t FROM o GROUP BY k),
i AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS link_key FROM customer)
SELECT link_key, 'o:' || out_id AS src_event_id, 'c:' || link_key AS dst_event_id FROM x JOIN i USING (link_key)""",
)
def stream_links_last_out(spark, sf):
    """All orders of a customer are outs of one key; the customer's last row, after them, is the in."""
    outs = _stream(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("link_key"), F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("c:"), "o_custkey").alias("entity_id"), F.concat(F.lit("o:"), "o_orderkey").alias("event_id"),
    )
    customers = _stream(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("link_key"), "c_custkey")
    ins = customers.select(
        "link_key", F.lit("2024-01-01").cast("timestamp").alias("timestamp"),
        F.lit("s").alias("entity_id"), F.concat(F.lit("c:"), "c_custkey").alias("event_id"),
    )
    # a row far behind all others moves the watermark past them
    end = customers.where("c_custkey = 1").select(
        F.lit("end").alias("link_key"), F.lit("2099-01-01").cast("timestamp").alias("timestamp"),
        F.lit("s").alias("entity_id"), F.lit("end").alias("event_id"),
    )
    base = f"{shared_folder(spark)}/last-out-{uuid.uuid4().hex}"
    found = match_continuous(outs.unionByName(end), ins, max_delay=timedelta(days=12_000))
    partitions = spark.sparkContext.defaultParallelism
    links = jobs.run_available(found, f"{base}/rows", f"{base}/checkpoint", state_partitions=partitions, state_store=STATE_STORE)
    return links.where(F.col("dst_event_id").isNotNull()).select("link_key", "src_event_id", "dst_event_id")

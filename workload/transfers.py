"""Matching transfers, trajectories across systems, what follows an arrival."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wayline.operators import chain_links, funnel, links as L, rollups, trajectory as T
from workload.registry import query
from workload.standins import INS_SQL, LINKS_SQL, OUTS_SQL, lineitem_ins, order_outs

DAY = timedelta(days=1)
BASE_SQL = f"WITH {OUTS_SQL}, {INS_SQL}, {LINKS_SQL}"


@query(
    "links_matched",
    f"""{BASE_SQL}
SELECT link_key, link_key_type, chain AS src_chain, "timestamp" AS src_block_time, tx_hash AS src_tx_hash, entity_id AS src_entity_id,
  event_id AS src_event_id, 'order' AS token, amount, dst_chain, dst_ts AS dst_block_time, tx_hash AS dst_tx_hash, dst_entity_id, dst_event_id
FROM links WHERE dst_event_id IS NOT NULL""",
)
def links_matched(spark, sf):
    rows = L.match(order_outs(spark, sf), lineitem_ins(spark, sf))
    return rows.withColumn("amount", F.col("amount").cast("bigint"))


@query(
    "links_pending",
    f"""{BASE_SQL}
SELECT link_key, link_key_type, entity_id AS src_entity_id, event_id AS src_event_id FROM links WHERE dst_event_id IS NULL""",
)
def links_pending(spark, sf):
    rows = L.pending(order_outs(spark, sf), lineitem_ins(spark, sf))
    return rows.select("link_key", "link_key_type", "src_entity_id", "src_event_id")


@query(
    "links_stats",
    f"""{BASE_SQL} SELECT count(*) FILTER (dst_event_id IS NULL) AS pending, count(dst_event_id) AS completed FROM links""",
)
def links_stats(spark, sf):
    return L.link_stats(L.reconcile(order_outs(spark, sf), lineitem_ins(spark, sf)))


@query(
    "links_hot_key",
    f"""WITH {OUTS_SQL}, {INS_SQL},
o AS (SELECT link_key_type AS link_key, arg_max(event_id, ("timestamp", event_id)) AS src_event_id FROM outs GROUP BY 1),
i AS (SELECT CASE protocol WHEN 'A' THEN '1-URGENT' WHEN 'N' THEN '2-HIGH' ELSE '5-LOW' END AS link_key,
        arg_min(event_id, ("timestamp", event_id)) AS dst_event_id FROM ins GROUP BY 1)
SELECT o.link_key, o.src_event_id, i.dst_event_id FROM o LEFT JOIN i USING (link_key)""",
)
def links_hot_key(spark, sf):
    # keys shared by a large part of all rows, as when a chain id is the key
    outs = order_outs(spark, sf).withColumn("link_key", F.col("link_key_type"))
    key = F.when(F.col("protocol") == "A", "1-URGENT").when(F.col("protocol") == "N", "2-HIGH").otherwise("5-LOW")
    ins = lineitem_ins(spark, sf).withColumn("link_key", key)
    return L.reconcile(outs, ins).select("link_key", "src_event_id", "dst_event_id")


@query(
    "links_in_window",
    f"""WITH {OUTS_SQL}, {INS_SQL},
o AS (SELECT * FROM outs WHERE "timestamp" BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-05-30'),
i AS (SELECT link_key, arg_min(event_id, ("timestamp", event_id)) AS dst_event_id FROM ins
      WHERE "timestamp" BETWEEN TIMESTAMP '1996-12-01' AND TIMESTAMP '1997-05-30' GROUP BY 1)
SELECT o.event_id AS src_event_id, i.dst_event_id, i.dst_event_id IS NOT NULL AS is_matched FROM o LEFT JOIN i USING (link_key)""",
)
def links_in_window(spark, sf):
    events = order_outs(spark, sf).unionByName(lineitem_ins(spark, sf))
    rows = L.match_window(events, datetime(1997, 5, 30), 90 * DAY)
    return rows.select("src_event_id", "dst_event_id", "is_matched")


STRICT_SQL = f"""WITH {OUTS_SQL}, {INS_SQL},
o AS (SELECT entity_id AS link_key, event_id AS src_event_id, "timestamp" AS ts FROM (
        SELECT *, row_number() OVER (PARTITION BY entity_id, "timestamp" ORDER BY event_id DESC) AS rn FROM outs) WHERE rn = 1),
i AS (SELECT outs.entity_id AS link_key, ins.event_id AS dst_event_id, ins."timestamp" AS ts
      FROM ins JOIN outs ON outs.link_key = ins.link_key),
p AS (SELECT i.*, o.src_event_id, o.ts AS src_ts FROM i ASOF JOIN o ON o.link_key = i.link_key AND i.ts >= o.ts)
SELECT src_event_id, arg_min(dst_event_id, (ts, dst_event_id)) AS dst_event_id FROM p
WHERE ts <= src_ts + INTERVAL 60 DAY GROUP BY 1"""


@query("links_strict", STRICT_SQL)
def links_strict(spark, sf):
    # the customer is the key: it repeats on both sides
    outs, ins = order_outs(spark, sf), lineitem_ins(spark, sf)
    owners = outs.select("link_key", F.col("entity_id").alias("__owner"))
    # the hash travels as bytes, which sort like its hex digits and take half the room in each shuffle
    ins = ins.withColumn("event_id", F.unhex("event_id"))
    ins = ins.join(owners, "link_key").withColumn("link_key", F.col("__owner")).drop("__owner")
    typed = {"link_key_type": F.lit("customer")}
    rows = L.match_strict(
        outs.withColumns({**typed, "link_key": F.col("entity_id")}), ins.withColumns(typed), max_delay=60 * DAY
    )
    return rows.select("src_event_id", F.lower(F.hex("dst_event_id")).alias("dst_event_id"))


@query(
    "links_by_chain",
    f"""WITH {OUTS_SQL}, {INS_SQL}, r AS (
  SELECT entity_id AS k, link_key_type AS c, "timestamp" AS ts, event_id, 1 AS d FROM outs
  UNION ALL SELECT outs.entity_id, outs.link_key_type, ins."timestamp", ins.event_id, -1 FROM ins JOIN outs ON outs.link_key = ins.link_key),
s AS (SELECT *, sum(d) OVER w AS s FROM r WINDOW w AS (PARTITION BY k, c ORDER BY ts, d DESC, event_id ROWS UNBOUNDED PRECEDING)),
m AS (
  SELECT *, least(0, min(s) OVER (w ROWS UNBOUNDED PRECEDING)) AS m, coalesce(least(0, min(s) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0) AS m0
  FROM s WINDOW w AS (PARTITION BY k, c ORDER BY ts, d DESC, event_id)),
l AS (SELECT *, s - m + CASE WHEN d = 1 THEN 0 ELSE 1 END AS level FROM m WHERE d = 1 OR s >= m0),
p AS (SELECT *, lag(event_id) OVER w AS src_event_id, lag(ts) OVER w AS src_ts FROM l WINDOW w AS (PARTITION BY k, c, level ORDER BY ts, d DESC, event_id))
SELECT src_event_id, event_id AS dst_event_id FROM p WHERE d = -1 AND ts <= src_ts + INTERVAL 60 DAY""",
)
def links_by_chain(spark, sf):
    # the customer is the key and the order's priority its origin chain: both repeat
    # ids travel as bytes, the hash of a line item in half the room of its hex digits
    outs, ins = order_outs(spark, sf), lineitem_ins(spark, sf).withColumn("event_id", F.unhex("event_id"))
    owners = outs.select("link_key", F.col("entity_id").alias("__owner"), F.col("link_key_type").alias("__origin"))
    ins = ins.join(owners, "link_key").withColumn("link_key", F.col("__owner"))
    typed = {"link_key_type": F.lit("customer")}
    outs = outs.withColumns({"chain": F.col("link_key_type"), "link_key": F.col("entity_id"), "event_id": F.col("event_id").cast("binary")})
    rows = chain_links.match_by_chain(
        outs.withColumns(typed), ins.withColumns(typed), origin=F.col("__origin"), max_delay=60 * DAY, bucket=90 * DAY,
        columns=["src_event_id", "dst_event_id"],
    )
    return rows.select(F.col("src_event_id").cast("string").alias("src_event_id"), F.lower(F.hex("dst_event_id")).alias("dst_event_id"))


@query(
    "links_sample",
    f"""{BASE_SQL} SELECT link_key_type, link_key, sample_no FROM (
  SELECT *, row_number() OVER (PARTITION BY link_key_type ORDER BY sha256(link_key)) AS sample_no
  FROM links WHERE dst_event_id IS NOT NULL) WHERE sample_no <= 50""",
)
def links_sample(spark, sf):
    rows = L.sample_links(L.match(order_outs(spark, sf), lineitem_ins(spark, sf)))
    return rows.select("link_key_type", "link_key", F.col("sample_no").cast("bigint").alias("sample_no"))


@query(
    "link_rows",
    f"""{BASE_SQL} SELECT link_key, link_key_type, amount, NULL::DOUBLE AS amount_usd, 1.0::DOUBLE AS link_confidence,
  TIMESTAMP '2024-01-01' AS validated_at FROM links WHERE dst_event_id IS NOT NULL""",
)
def link_rows(spark, sf):
    rows = L.link_rows(L.match(order_outs(spark, sf), lineitem_ins(spark, sf)), datetime(2024, 1, 1))
    return rows.select(
        "link_key", "link_key_type", F.col("amount").cast("bigint").alias("amount"),
        F.col("amount_usd").cast("double").alias("amount_usd"), "link_confidence", "validated_at",
    )


ACROSS_SQL = f"""{BASE_SQL},
ev AS (SELECT entity_id, event_id, 'bridge_out' AS event_type, "timestamp", chain, link_key FROM outs
       UNION ALL SELECT entity_id, event_id, 'bridge_in', "timestamp", chain, link_key FROM ins),
a AS (SELECT entity_id, max("timestamp") AS anchor_ts FROM ev WHERE event_type = 'bridge_out' GROUP BY 1),
near AS (SELECT a.entity_id AS query_entity_id, a.anchor_ts, ev.* FROM ev JOIN a USING (entity_id)
         WHERE ev."timestamp" BETWEEN a.anchor_ts - INTERVAL 180 DAY AND a.anchor_ts + INTERVAL 30 DAY),
b AS (SELECT query_entity_id, anchor_ts, min("timestamp") AS lo, max("timestamp") AS hi FROM near GROUP BY 1, 2),
far AS (SELECT DISTINCT n.query_entity_id, l.dst_entity_id, l.dst_chain FROM near n
        JOIN links l ON l.link_key = n.link_key AND l.entity_id = n.entity_id
        WHERE n.event_type = 'bridge_out' AND l.dst_entity_id IS NOT NULL),
added AS (SELECT DISTINCT f.query_entity_id, b.anchor_ts, ev.event_id, ev.event_type, ev."timestamp", ev.entity_id, ev.chain
          FROM far f JOIN b USING (query_entity_id)
          JOIN ev ON ev.entity_id = f.dst_entity_id AND ev.chain = f.dst_chain AND ev."timestamp" BETWEEN b.lo AND b.hi),
journey AS (
  SELECT query_entity_id, anchor_ts, event_id, event_type, "timestamp", entity_id, chain FROM near
  UNION ALL SELECT query_entity_id, anchor_ts, event_id, event_type, "timestamp", entity_id, chain FROM added)"""


def _across(spark, sf, **options):
    # ids travel as bytes, the hash of a line item in half the room of its hex digits
    outs = order_outs(spark, sf).withColumn("event_id", F.col("event_id").cast("binary"))
    ins = lineitem_ins(spark, sf).withColumn("event_id", F.unhex("event_id"))
    links = L.match(outs, ins, columns=["src_entity_id", "dst_entity_id", "dst_chain"])
    return T.trajectory_across(outs.unionByName(ins), links, "bridge_out", 180 * DAY, 30 * DAY, **options)


@query("trajectory_across", f"{ACROSS_SQL} SELECT query_entity_id, anchor_ts, event_id, event_type, \"timestamp\", entity_id, chain FROM journey")
def trajectory_across(spark, sf):
    rows = _across(spark, sf, ordered=False)
    is_out = F.col("event_type") == "bridge_out"
    event_id = F.when(is_out, F.col("event_id").cast("string")).otherwise(F.lower(F.hex("event_id")))
    return rows.withColumn("event_id", event_id).select(
        "query_entity_id", "anchor_ts", "event_id", "event_type", "timestamp", "entity_id", "chain"
    )


@query(
    "unified_funnel",
    f"""{ACROSS_SQL}, s AS (
  SELECT query_entity_id, count(*) AS n_steps, min(CASE WHEN event_type = 'bridge_out' THEN "timestamp" END) AS bridge_ts,
    min(CASE WHEN event_type = 'bridge_in' THEN "timestamp" END) AS swap_ts FROM journey GROUP BY 1)
SELECT query_entity_id, n_steps, 0.0::DOUBLE AS time_to_bridge,
  (epoch_us(swap_ts) - epoch_us(bridge_ts)) / 1000000.0::DOUBLE AS time_to_swap, swap_ts IS NOT NULL AS converted FROM s""",
)
def unified_funnel(spark, sf):
    # orders are both the sessions and the transfers, deliveries the swaps
    rows = funnel.summarise(_across(spark, sf, ordered=False), session="bridge_out", swap="bridge_in")
    return rows.select("query_entity_id", "n_steps", "time_to_bridge", "time_to_swap", "converted")


ARRIVALS_SQL = f"""WITH {OUTS_SQL}, {INS_SQL},
arr AS (SELECT entity_id, "timestamp", event_id FROM outs),
oth AS (SELECT o.entity_id, i."timestamp", i.event_id, i.protocol FROM ins i JOIN outs o USING (link_key)),
u AS (SELECT entity_id, "timestamp" AS ts, max(event_id) AS arrival_id FROM arr GROUP BY 1, 2),
f AS (SELECT oth.*, u.ts AS arrival_ts, u.arrival_id FROM oth ASOF JOIN u ON u.entity_id = oth.entity_id AND oth."timestamp" >= u.ts),
followed AS (SELECT * FROM f WHERE "timestamp" <= arrival_ts + INTERVAL 60 DAY)"""


def _arrivals(spark, sf):
    """Orders as arrivals of a customer, the customer's line items as what follows.

    Event ids are bytes, of the hash itself for line items: they sort alike and take half the room in a shuffle.
    """
    outs, ins = order_outs(spark, sf), lineitem_ins(spark, sf)
    ins = ins.withColumn("event_id", F.unhex("event_id"))
    owners = outs.select("link_key", F.col("entity_id").alias("__owner"))
    kind = F.when(F.col("protocol") == "A", F.lit("swap")).otherwise(F.lit("deposit"))
    ins = (
        ins.join(owners, "link_key")
        .withColumns({"entity_id": F.col("__owner"), "event_type": kind})
        .drop("__owner")
    )
    outs = outs.withColumns({"event_type": F.lit("bridge_in"), "event_id": F.col("event_id").cast("binary")})
    return outs.unionByName(ins)


@query(
    "next_events_after_arrival",
    f"""{ARRIVALS_SQL} SELECT arrival_id, position, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY arrival_id ORDER BY "timestamp", event_id) AS position FROM followed) WHERE position <= 3""",
)
def next_events_after_arrival(spark, sf):
    followed = rollups.after_arrivals(_arrivals(spark, sf), within=60 * DAY)
    rows = rollups.next_events(followed, 3)
    ids = F.col("arrival_id").cast("string").alias("arrival_id"), F.lower(F.hex("event_id")).alias("event_id")
    return rows.select(ids[0], F.col("position").cast("bigint").alias("position"), ids[1])


@query(
    "arrival_outcomes",
    f"""{ARRIVALS_SQL}, p AS (SELECT arrival_id, max(CASE WHEN protocol = 'A' THEN 1 ELSE 0 END) AS acted FROM followed GROUP BY 1),
j AS (SELECT outs.protocol, p.acted FROM outs LEFT JOIN p ON p.arrival_id = outs.event_id)
SELECT protocol, count(*) AS n_arrivals, count(*) FILTER (acted = 1) AS n_acted, count(*) FILTER (acted IS NULL) AS n_idle,
  round(count(*) FILTER (acted = 1) / count(*)::DOUBLE, 6) AS acted_rate, round(count(*) FILTER (acted IS NULL) / count(*)::DOUBLE, 6) AS idle_rate
FROM j GROUP BY 1""",
)
def arrival_outcomes(spark, sf):
    return rollups.arrival_outcomes(_arrivals(spark, sf), within=60 * DAY, keys=["protocol"])


@query(
    "apps_after_arrival",
    f"""{ARRIVALS_SQL} SELECT protocol, count(*) AS n_events, count(DISTINCT entity_id) AS n_entities FROM followed GROUP BY 1""",
)
def apps_after_arrival(spark, sf):
    return rollups.apps_after_arrivals(rollups.after_arrivals(_arrivals(spark, sf), within=60 * DAY))

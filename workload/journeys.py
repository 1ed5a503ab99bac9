"""Trajectories, funnels, rollups and validation over product events."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wayline.operators import funnel, funnel_scan, registry, rollups, trajectory as T
from wayline.operators.trajectory import Filter
from wayline.schema import extra_map, from_storage_nulls
from wayline.session import shared_folder
from wayline.sinks import snapshots, tables
from wayline.streaming.anchor_index import AnchorIndex
from workload.registry import query
from workload.standins import APP_EVENTS_SQL as EV
from workload.standins import app_events, load

DAY = timedelta(days=1)
SHORT = ["query_entity_id", "anchor_ts", "event_id", "event_type", "timestamp"]
ANCHOR_SQL = f"""{EV}, a AS (
  SELECT entity_id, max("timestamp") AS anchor_ts FROM ev WHERE event_type = 'purchase' GROUP BY 1
)"""
WINDOW_SQL = f"""WITH {ANCHOR_SQL}
SELECT a.entity_id AS query_entity_id, a.anchor_ts, ev.event_id, ev.event_type, ev."timestamp"
FROM ev JOIN a USING (entity_id)
WHERE ev."timestamp" BETWEEN a.anchor_ts - INTERVAL 1 DAY AND a.anchor_ts + INTERVAL 1 DAY"""


@query("anchor_latest", f"WITH {ANCHOR_SQL} SELECT entity_id, anchor_ts FROM a")
def anchor_latest(spark, sf):
    return T.anchors(app_events(spark, sf), "purchase")


@query("trajectory_window", WINDOW_SQL)
def trajectory_window(spark, sf):
    return T.trajectory(app_events(spark, sf), "purchase", DAY, DAY).select(*SHORT)


@query("trajectory_without_anchor", WINDOW_SQL + " AND ev.event_type <> 'purchase'")
def trajectory_without_anchor(spark, sf):
    return T.trajectory(app_events(spark, sf), "purchase", DAY, DAY, include_anchor=False).select(*SHORT)


@query(
    "trajectory_filtered",
    WINDOW_SQL
    + """ AND ev.event_type IN ('view', 'click', 'purchase') AND ev.event_type NOT IN ('click')
  AND ev.source_event_id NOT LIKE '%7' AND ev.source_event_id LIKE '%1%' AND ev."timestamp" >= TIMESTAMP '2024-01-10'
  AND ev."timestamp" < TIMESTAMP '2024-01-30' AND ev.entity_id <> '3' AND ev.source_event_id > '1'
  AND ev.source_event_id <= '9'""",
)
def trajectory_filtered(spark, sf):
    filters = [
        Filter("event_type", "IN", ["view", "click", "purchase"]),
        Filter("event_type", "not in", ["click"]),
        Filter("source_event_id", "NOT LIKE", "%7"),
        Filter("source_event_id", "like", "%1%"),
        Filter("timestamp", ">=", datetime(2024, 1, 10)),
        Filter("timestamp", "<", datetime(2024, 1, 30)),
        Filter("entity_id", "!=", "3"),
        Filter("source_event_id", ">", "1"),
        Filter("source_event_id", "<=", "9"),
        Filter("source_system", "=", "app"),
    ]
    return T.trajectory(app_events(spark, sf), "purchase", DAY, DAY, filters=filters).select(*SHORT)


@query(
    "trajectory_of_users",
    f"""WITH {ANCHOR_SQL}
SELECT a.entity_id AS query_entity_id, a.anchor_ts, ev.event_id, ev.event_type, ev."timestamp"
FROM ev JOIN a USING (entity_id)
WHERE a.entity_id IN ('8', '46') AND ev."timestamp" BETWEEN a.anchor_ts - INTERVAL 30 DAY AND a.anchor_ts + INTERVAL 30 DAY""",
)
def trajectory_of_users(spark, sf):
    events = app_events(spark, sf)
    return T.trajectory(events, "purchase", 30 * DAY, 30 * DAY, roots=["8", "46"]).select(*SHORT)


@query(
    "trajectory_without_internal",
    f"""WITH {ANCHOR_SQL}
SELECT a.entity_id AS query_entity_id, a.anchor_ts, ev.event_id, ev.event_type, ev."timestamp"
FROM ev JOIN a USING (entity_id)
WHERE ev."timestamp" BETWEEN a.anchor_ts - INTERVAL 1 DAY AND a.anchor_ts + INTERVAL 1 DAY AND ev.event_type <> 'error'""",
)
def trajectory_without_internal(spark, sf):
    # errors stand in for the internal legs of an aggregated swap
    kind = F.when(F.col("event_type") == "error", F.lit("swap_internal")).otherwise(F.col("event_type"))
    events = app_events(spark, sf).withColumn("event_type", kind)
    return T.trajectory(events, "purchase", DAY, DAY, exclude_internal=True).select(*SHORT)


@query(
    "trajectory_index",
    f"""WITH {ANCHOR_SQL}
SELECT ev.entity_id, a.anchor_ts, ev.event_id,
       (epoch_us(ev."timestamp") - epoch_us(a.anchor_ts)) / 1000000.0::DOUBLE AS offset_seconds
FROM ev JOIN a USING (entity_id)
WHERE ev."timestamp" BETWEEN a.anchor_ts - INTERVAL 1 DAY AND a.anchor_ts + INTERVAL 1 DAY""",
)
def trajectory_index(spark, sf):
    return T.trajectory_index(app_events(spark, sf), "purchase", DAY, DAY)


@query(
    "trajectory_index_maintained",
    f"""WITH {ANCHOR_SQL}
SELECT a.entity_id, a.anchor_ts, ev.event_id, (epoch_us(ev."timestamp") - epoch_us(a.anchor_ts)) / 1000000.0::DOUBLE AS offset_seconds
FROM ev JOIN a USING (entity_id) WHERE ev."timestamp" BETWEEN a.anchor_ts - INTERVAL 1 DAY AND a.anchor_ts + INTERVAL 1 DAY""",
)
def trajectory_index_maintained(spark, sf):
    """Four batches, each with events of all times; the third comes twice."""
    index = AnchorIndex(f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", "purchase", DAY, DAY)
    rows = tables.event_rows(app_events(spark, sf))
    part = F.pmod(F.xxhash64("event_id"), F.lit(4))
    for number in (0, 1, 2, 2, 3):
        index.update(rows.where(part == number), number)
    return index.read(spark)


@query("event_identity", "SELECT event_id AS source_event_id, sha256('app:' || event_id) AS event_id FROM events")
def event_identity(spark, sf):
    return app_events(spark, sf).select(F.col("source_event_id").cast("bigint").alias("source_event_id"), "event_id")


STEPS = ["signup", "view", "click", "purchase"]
FUNNEL_SQL = f"""{EV},
s1 AS (SELECT entity_id, min("timestamp") AS step_1_ts FROM ev WHERE event_type = 'signup' GROUP BY 1),
s2 AS (SELECT s1.*, (SELECT min("timestamp") FROM ev WHERE ev.entity_id = s1.entity_id AND event_type = 'view'
       AND "timestamp" > step_1_ts AND "timestamp" <= step_1_ts + INTERVAL 2 DAY) AS step_2_ts FROM s1),
s3 AS (SELECT s2.*, (SELECT min("timestamp") FROM ev WHERE ev.entity_id = s2.entity_id AND event_type = 'click'
       AND "timestamp" > step_2_ts AND "timestamp" <= step_1_ts + INTERVAL 2 DAY) AS step_3_ts FROM s2),
s4 AS (SELECT s3.*, (SELECT min("timestamp") FROM ev WHERE ev.entity_id = s3.entity_id AND event_type = 'purchase'
       AND "timestamp" > step_3_ts AND "timestamp" <= step_1_ts + INTERVAL 2 DAY) AS step_4_ts FROM s3)"""


@query("ordered_funnel", f"WITH {FUNNEL_SQL} SELECT * FROM s4")
def ordered_funnel(spark, sf):
    return funnel.ordered_funnel(app_events(spark, sf), STEPS, within=2 * DAY)


@query(
    "ordered_funnel_counts",
    f"""WITH {FUNNEL_SQL}, c AS (
  SELECT count(step_1_ts) AS n1, count(step_2_ts) AS n2, count(step_3_ts) AS n3, count(step_4_ts) AS n4 FROM s4)
SELECT * FROM (
  SELECT 1 AS step, 'signup' AS event_type, n1 AS n_entities, 1.0::DOUBLE AS rate_from_first, 1.0::DOUBLE AS rate_from_previous FROM c
  UNION ALL SELECT 2, 'view', n2, round(n2 / n1::DOUBLE, 6), round(n2 / n1::DOUBLE, 6) FROM c
  UNION ALL SELECT 3, 'click', n3, round(n3 / n1::DOUBLE, 6), round(n3 / n2::DOUBLE, 6) FROM c
  UNION ALL SELECT 4, 'purchase', n4, round(n4 / n1::DOUBLE, 6), round(n4 / n3::DOUBLE, 6) FROM c)""",
)
def ordered_funnel_counts(spark, sf):
    reached = funnel.ordered_funnel(app_events(spark, sf), STEPS, within=2 * DAY)
    return funnel.funnel_counts(reached, STEPS)


ANY_START = ["view", "click", "view", "purchase"]
ANY_START_SQL = f"""WITH {EV}, e AS (
  SELECT entity_id, epoch_us("timestamp") AS t, unnest(CASE event_type WHEN 'view' THEN [1, 3] WHEN 'click' THEN [2] ELSE [4] END) AS k
  FROM ev WHERE event_type IN ('view', 'click', 'purchase')),
""" + "".join(
    f"""s{k} AS (SELECT entity_id, t, k, {"CASE WHEN k = 1 THEN t END" if k == 1 else f"CASE WHEN k = {k} THEN before ELSE start END"} AS start
  FROM {"e" if k == 1 else f"(SELECT *, max(CASE WHEN k = {k - 1} THEN start END) OVER (PARTITION BY entity_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT entity_id, t, k, start FROM s{k - 1}))"}),
"""
    for k in range(1, 5)
) + f"""
timely AS (SELECT entity_id, k, t, start FROM s4 WHERE t - start <= {48 * 3_600_000_000}),
best AS (SELECT entity_id, max(k) AS depth FROM timely GROUP BY 1),
found AS (SELECT entity_id, depth, min(t) AS t, max_by(start, -t) AS start FROM timely JOIN best USING (entity_id) WHERE k = depth GROUP BY 1, 2)"""


@query(
    "windowed_funnel",
    ANY_START_SQL + " SELECT entity_id, depth::INT AS depth, make_timestamp(start) AS started_at, make_timestamp(t) AS reached_at FROM found",
)
def windowed_funnel(spark, sf):
    return funnel_scan.windowed_funnel(app_events(spark, sf), ANY_START, timedelta(hours=48))


@query(
    "windowed_funnel_counts",
    ANY_START_SQL
    + """, c AS (SELECT k, (SELECT count(*) FROM found WHERE depth >= k) AS n FROM range(1, 5) r(k))
SELECT k::INT AS step, ['view', 'click', 'view', 'purchase'][k] AS event_type, n AS n_entities,
  round(n / (SELECT n FROM c WHERE k = 1), 6) AS rate_from_first,
  round(n / nullif((SELECT n FROM c x WHERE x.k = greatest(c.k - 1, 1)), 0), 6) AS rate_from_previous
FROM c""",
)
def windowed_funnel_counts(spark, sf):
    found = funnel_scan.windowed_funnel(app_events(spark, sf), ANY_START, timedelta(hours=48))
    return funnel_scan.depth_counts(found, ANY_START)


RETENTION_SQL = f"""{EV},
f AS (SELECT entity_id, date_trunc('week', min("timestamp"))::TIMESTAMP AS cohort_week FROM ev GROUP BY 1),
w AS (SELECT DISTINCT entity_id, date_trunc('week', "timestamp")::TIMESTAMP AS week FROM ev WHERE event_type = 'purchase'),
n AS (SELECT cohort_week, CAST(date_diff('day', cohort_week, week) / 7 AS INTEGER) AS week_no, count(*) AS n_active
      FROM w JOIN f USING (entity_id) GROUP BY 1, 2),
c AS (SELECT cohort_week, count(*) AS cohort_size FROM f GROUP BY 1),
r AS (SELECT n.*, c.cohort_size, round(n_active / cohort_size::DOUBLE, 6) AS share FROM n JOIN c USING (cohort_week))"""


@query("cohort_retention", f"WITH {RETENTION_SQL} SELECT * FROM r")
def cohort_retention(spark, sf):
    return funnel.cohort_retention(app_events(spark, sf), "purchase")


@query(
    "channel_retention",
    f"""WITH {EV},
f AS (SELECT entity_id, date_trunc('week', min("timestamp"))::TIMESTAMP AS cohort_week,
        'ch' || arg_min(CAST(json_extract_string(extra, '$.k') AS INTEGER) % 4, ("timestamp", event_id)) AS channel FROM ev GROUP BY 1),
w AS (SELECT DISTINCT entity_id, date_trunc('week', "timestamp")::TIMESTAMP AS week FROM ev WHERE event_type = 'purchase'),
n AS (SELECT cohort_week, channel, CAST(date_diff('day', cohort_week, week) / 7 AS INTEGER) AS week_no, count(*) AS n_active
      FROM w JOIN f USING (entity_id) GROUP BY 1, 2, 3),
c AS (SELECT cohort_week, channel, count(*) AS cohort_size FROM f GROUP BY 1, 2)
SELECT n.*, cohort_size, round(n_active / cohort_size::DOUBLE, 6) AS share
FROM n JOIN c ON c.cohort_week = n.cohort_week AND c.channel IS NOT DISTINCT FROM n.channel""",
)
def channel_retention(spark, sf):
    channel = F.concat(F.lit("ch"), (F.get_json_object("extra", "$.k").cast("int") % 4).cast("string"))
    return funnel.cohort_retention(app_events(spark, sf), "purchase", channel=channel)


@query(
    "retention_table",
    f"""WITH {RETENTION_SQL} SELECT cohort_week, max(CASE WHEN week_no = 0 THEN share END) AS "0",
  max(CASE WHEN week_no = 1 THEN share END) AS "1", max(CASE WHEN week_no = 2 THEN share END) AS "2",
  max(CASE WHEN week_no = 3 THEN share END) AS "3" FROM r GROUP BY 1""",
)
def retention_table(spark, sf):
    return funnel.retention_table(funnel.cohort_retention(app_events(spark, sf), "purchase"), 4)


@query(
    "drop_off",
    """WITH e AS (SELECT user_id, max(CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-03' THEN 1 ELSE 0 END) AS d,
       max(CASE WHEN event_type = 'purchase' AND ts < TIMESTAMP '2024-01-06' THEN 1 ELSE 0 END) AS n FROM events GROUP BY 1)
SELECT count(*) AS n_entities, count(*) FILTER (n = 0) AS n_dropped,
       round(count(*) FILTER (n = 0) / count(*)::DOUBLE, 6) AS share FROM e WHERE d = 1""",
)
def drop_off(spark, sf):
    early = F.col("timestamp") < F.lit(datetime(2024, 1, 6))
    did = (F.col("event_type") == "view") & (F.col("timestamp") < F.lit(datetime(2024, 1, 3)))
    return funnel.drop_off(app_events(spark, sf), did, (F.col("event_type") == "purchase") & early)


HOURLY_SQL = """h AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n_events FROM events GROUP BY 1, 2)"""


@query("hourly_counts", f"WITH {HOURLY_SQL} SELECT * FROM h")
def hourly_counts(spark, sf):
    return rollups.hourly_counts(app_events(spark, sf), ["event_type"])


@query(
    "trending",
    f"""WITH {HOURLY_SQL}
SELECT h.*, b.n_events AS n_before, h.n_events / b.n_events::DOUBLE AS growth
FROM h JOIN h b ON b.event_type = h.event_type AND b.hour = h.hour - INTERVAL 24 HOUR
WHERE h.n_events / b.n_events::DOUBLE > 3""",
)
def trending(spark, sf):
    return rollups.trending(rollups.hourly_counts(app_events(spark, sf), ["event_type"]), ["event_type"])


FEED_SQL = f"""{EV}, feed AS (
  SELECT entity_id, event_type, "timestamp" FROM ev ORDER BY "timestamp" DESC, event_id LIMIT 100)"""


@query("recent_events", f"WITH {FEED_SQL} SELECT * FROM feed")
def recent_events(spark, sf):
    return rollups.recent_events(app_events(spark, sf)).select("entity_id", "event_type", "timestamp")


@query("feed_type_counts", f"WITH {FEED_SQL} SELECT event_type, count(*) AS n_events FROM feed GROUP BY 1")
def feed_type_counts(spark, sf):
    return rollups.feed_type_counts(rollups.recent_events(app_events(spark, sf)))


@query("feed_newest", f"""WITH {FEED_SQL} SELECT * FROM feed ORDER BY "timestamp" DESC LIMIT 20""")
def feed_newest(spark, sf):
    feed = rollups.recent_events(app_events(spark, sf))
    return rollups.newest(feed).select("entity_id", "event_type", "timestamp")


def _app_registry(spark, with_error=False):
    types = dict(registry.EVENT_TYPES)
    types |= {
        "view": registry.EventType("acquisition", ("k",)),
        "click": registry.EventType("acquisition", ("k", "url")),
        "purchase": registry.EventType("product", ("amount_in", "entity_id", "plan")),
    }
    if with_error:
        types["error"] = registry.EventType("product", ("k",))
    return registry.registry_frame(spark, types)


VALID_SQL = """SELECT sha256('app:' || event_id) AS event_id, event_type IN ('signup', 'view', 'click', 'purchase'{more}) AS is_valid,
  CASE event_type WHEN 'signup' THEN 'lifecycle' WHEN 'view' THEN 'acquisition' WHEN 'click' THEN 'acquisition'
    WHEN 'purchase' THEN 'product' {category} END AS registry_category,
  CASE event_type WHEN 'signup' THEN 'user_id' WHEN 'view' THEN '' WHEN 'click' THEN 'url' WHEN 'purchase' THEN 'amount_in,plan' {missing} END AS missing
FROM events"""


def _validated(spark, sf, with_error):
    rows = registry.validate(app_events(spark, sf), _app_registry(spark, with_error))
    return rows.select("event_id", "is_valid", "registry_category", F.array_join("missing", ",").alias("missing"))


@query("registry_validation", VALID_SQL.format(more="", category="", missing=""))
def registry_validation(spark, sf):
    return _validated(spark, sf, False)


@query(
    "registry_extension",
    VALID_SQL.format(more=", 'error'", category="WHEN 'error' THEN 'product'", missing="WHEN 'error' THEN ''"),
)
def registry_extension(spark, sf):
    return _validated(spark, sf, True)


@query(
    "registry_categories",
    """SELECT CASE event_type WHEN 'signup' THEN 'lifecycle' WHEN 'purchase' THEN 'product' WHEN 'error' THEN NULL ELSE 'acquisition' END AS registry_category,
  count(*) AS n_events FROM events GROUP BY 1""",
)
def registry_categories(spark, sf):
    rows = registry.validate(app_events(spark, sf), _app_registry(spark))
    return rows.groupBy("registry_category").agg(F.count(F.lit(1)).alias("n_events"))


@query(
    "freshness",
    """SELECT event_type, count(*) AS n_rows, max(ts) AS newest,
  (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 1000000.0::DOUBLE AS age_seconds,
  (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 1000000.0::DOUBLE <= 176400 AS is_fresh, count(*) >= 200 AS has_rows
FROM events GROUP BY 1""",
)
def freshness(spark, sf):
    return registry.freshness(app_events(spark, sf), ["event_type"], datetime(2024, 2, 1), 176_400, 200)


@query(
    "storage_rows",
    """SELECT sha256('app:' || event_id) AS event_id, CAST(user_id AS VARCHAR) AS entity_id, '' AS chain, '' AS protocol, '' AS venue,
  '' AS aggregator, props AS extra FROM events""",
)
def storage_rows(spark, sf):
    rows = tables.event_rows(app_events(spark, sf))
    return rows.select("event_id", "entity_id", "chain", "protocol", "venue", "aggregator", "extra")


@query(
    "storage_read_back",
    """SELECT sha256('app:' || event_id) AS event_id, NULL::VARCHAR AS chain, NULL::VARCHAR AS protocol,
  json_extract_string(props, '$.k') AS k FROM events""",
)
def storage_read_back(spark, sf):
    rows = from_storage_nulls(tables.event_rows(app_events(spark, sf)))
    return rows.select("event_id", "chain", "protocol", extra_map("extra")["k"].alias("k"))


@query(
    "repeated_ingest",
    "SELECT event_type, count(*) AS n_events FROM events GROUP BY 1",
)
def repeated_ingest(spark, sf):
    # the second pull repeats the last part of the first
    first = app_events(spark, sf)
    again = first.where(F.col("timestamp") >= F.lit(datetime(2024, 1, 15)))
    both = tables.deduplicate(first.unionByName(again))
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"))


@query(
    "ingest_twice",
    """SELECT strftime(date_trunc('month', ts), '%Y-%m') AS month, count(*) AS n_events, count(DISTINCT event_id) AS n_ids
FROM events GROUP BY 1""",
)
def ingest_twice(spark, sf):
    """The table after a first pull, a second that overlaps it, and the second again."""
    path = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    rows = tables.event_rows(app_events(spark, sf))
    first, again = rows.where(F.col("timestamp") < F.lit(datetime(2024, 1, 20))), rows.where(F.col("timestamp") >= F.lit(datetime(2024, 1, 15)))
    for pull in (first, again, again):
        snapshots.insert_new(pull, path, "canonical_events")
    stored = tables.read_table(spark, path)
    counts = [F.count(F.lit(1)).alias("n_events"), F.countDistinct("event_id").alias("n_ids")]
    return stored.groupBy(F.date_format("event_month", "yyyy-MM").alias("month")).agg(*counts)

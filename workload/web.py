"""Landed web reports and product-event pages, built from the events table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from wayline.functions.scalars import cursor_of, minute_timestamp
from wayline.sources import product_events as PE
from wayline.sources import web_report as WR
from workload.registry import query
from workload.standins import load

REPORT_PAGE, PRODUCT_PAGE = 500, 100
LANDED = datetime(2024, 2, 1)


def report_pages(spark, sf):
    """Report responses as landed JSON, a pull per event-type group, 500 rows a page.

    Rows keep the order of event_id; every third page comes from the second pull.
    """
    values = [
        F.date_format("ts", "yyyyMMddHHmm"),
        F.when(F.col("event_type") == "view", "page_view")
        .when(F.col("event_type") == "signup", "session_start")
        .when(F.col("event_type") == "click", "user_engagement")
        .when(F.col("event_type") == "purchase", "first_visit")
        .otherwise("scroll"),
        F.concat(F.lit("s"), (F.col("event_id") % 977)),
        F.when(F.col("user_id") % 11 == 0, "").otherwise(F.concat(F.lit("u"), "user_id")),
        F.concat(F.lit("/p/"), (F.col("event_id") % 50)),
        F.lit(""),
        F.when(F.col("user_id") % 3 == 0, "google").otherwise(""),
        F.when(F.col("user_id") % 3 == 0, F.when(F.col("user_id") % 2 == 0, "cpc").otherwise("organic")).otherwise(""),
    ]
    headers = [
        "dateHourMinute", "eventName", "sessionId", "clientId", "pageLocation", "pageReferrer", "sessionSource", "sessionMedium",
    ]
    page = F.floor(F.col("event_id") / REPORT_PAGE)
    row = F.struct(F.array(*[F.struct(v.alias("value")) for v in values]).alias("dimensionValues"))
    # a page is a bounded group: 500 rows
    pages = (
        load(spark, sf, "events")
        .select(page.alias("page"), "event_id", row.alias("row"))
        .groupBy("page")
        .agg(F.array_sort(F.collect_list(F.struct("event_id", "row"))).alias("rows"))
    )
    body = F.struct(
        F.array(*[F.struct(F.lit(h).alias("name")) for h in headers]).alias("dimensionHeaders"),
        F.col("rows.row").alias("rows"),
    )
    schema = "dimensionHeaders array<struct<name:string>>, rows array<struct<dimensionValues:array<struct<value:string>>>>"
    return pages.select(
        F.when(F.col("page") % 3 == 0, "b").otherwise("a").alias("pull_id"),
        (F.col("page") * REPORT_PAGE).alias("page_offset"),
        F.lit(LANDED).alias("landed_at"),
        F.from_json(F.to_json(body), schema).alias("body"),
    ).select("pull_id", "page_offset", "landed_at", "body.*")


REPORT_SQL = f"""
rep AS (SELECT *, CASE WHEN (event_id // {REPORT_PAGE}) % 3 = 0 THEN 'b' ELSE 'a' END AS pull,
  CASE event_type WHEN 'view' THEN 'page_view' WHEN 'signup' THEN 'session_start' WHEN 'click' THEN 'user_engagement'
    WHEN 'purchase' THEN 'first_visit' ELSE 'scroll' END AS name,
  's' || (event_id % 977) AS session, CASE WHEN user_id % 11 = 0 THEN '' ELSE 'u' || user_id END AS client,
  strftime(ts, '%Y%m%d%H%M') AS minute, '/p/' || (event_id % 50) AS url FROM events),
idx AS (SELECT *, row_number() OVER (PARTITION BY pull ORDER BY event_id) - 1 AS row_index FROM rep),
web AS (SELECT *, sha256(client || ':' || session || ':' || name || ':' || minute || ':' || row_index)[1:32] AS sid,
  CASE name WHEN 'page_view' THEN 'pageview' ELSE name END AS etype FROM idx WHERE client <> '' AND name <> 'scroll')"""


@query("report_row_index", f"WITH {REPORT_SQL} SELECT row_index, name AS event_name, client AS client_id, minute FROM idx")
def report_row_index(spark, sf):
    return WR.report_rows(report_pages(spark, sf)).select("row_index", "event_name", "client_id", "minute")


@query(
    "web_report_events",
    f"""WITH {REPORT_SQL} SELECT client AS entity_id, 'device_id' AS entity_type, sha256('ga4:' || sid) AS event_id, sid AS source_event_id,
  etype AS event_type, 'acquisition' AS event_category, date_trunc('minute', ts)::TIMESTAMP AS "timestamp", 'ga4' AS source_system,
  '{{"session_id":"' || session || '","url":"' || url || '"' || CASE WHEN user_id % 3 = 0 THEN ',"utm_source":"google","utm_medium":"'
    || CASE WHEN user_id % 2 = 0 THEN 'cpc' ELSE 'organic' END || '"' ELSE '' END || '}}' AS extra FROM web""",
)
def web_report_events(spark, sf):
    rows = WR.report_events(report_pages(spark, sf))
    return rows.select(
        "entity_id", "entity_type", "event_id", "source_event_id", "event_type", "event_category", "timestamp", "source_system", "extra"
    )


@query(
    "web_report_stable_ids",
    f"""WITH {REPORT_SQL} SELECT sha256('ga4:' || sha256(client || ':' || session || ':' || name || ':' || minute)[1:32]) AS event_id, count(*) AS n
FROM web GROUP BY 1""",
)
def web_report_stable_ids(spark, sf):
    rows = WR.report_events(report_pages(spark, sf), stable_ids=True)
    return rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "report_minutes",
    """SELECT event_id, CASE WHEN event_id % 5 < 3 THEN date_trunc('minute', ts)::TIMESTAMP ELSE TIMESTAMP '2024-02-01' END AS ts FROM events""",
)
def report_minutes(spark, sf):
    good = F.date_format("ts", "yyyyMMddHHmm")
    text = F.when(F.col("event_id") % 5 < 3, good).when(F.col("event_id") % 5 == 3, F.left(good, F.lit(8))).otherwise(
        F.concat(F.lit("202413"), F.right(good, F.lit(6)))
    )
    return load(spark, sf, "events").select(
        "event_id", F.coalesce(minute_timestamp(text), F.lit(LANDED)).alias("ts")
    )


def product_pages(spark, sf):
    """Product-event responses as landed JSON, 100 events a page, linked by cursor."""
    name = (
        F.when(F.col("event_type") == "view", "$pageview")
        .when(F.col("event_type") == "signup", "$session_start")
        .when(F.col("event_type") == "click", "$autocapture")
        .otherwise("$pageleave")
    )
    properties = F.create_map(
        F.lit("$session_id"), F.concat(F.lit("s"), (F.col("event_id") % 977)),
        F.lit("$current_url"), F.concat(F.lit("https://x.example/"), (F.col("event_id") % 50)),
        F.lit("$referrer"), F.lit(""),
        F.lit("utm_source"), F.when(F.col("user_id") % 3 == 0, "news").cast("string"),
    )
    event = F.struct(
        F.when(F.col("user_id") % 13 != 0, F.concat(F.lit("d"), "user_id")).alias("distinct_id"),
        name.alias("event"),
        F.when(F.col("event_id") % 10 == 7, "invalid").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("timestamp"),
        properties.alias("properties"),
    )
    # a page is a bounded group: 100 events
    pages = (
        load(spark, sf, "events")
        .select(F.floor(F.col("event_id") / PRODUCT_PAGE).alias("page_no"), "event_id", event.alias("event"))
        .groupBy("page_no")
        .agg(F.array_sort(F.collect_list(F.struct("event_id", F.to_json("event").alias("event")))).alias("events"))
    )
    next_url = F.concat(F.lit("https://p.example/api/events?limit=100&after=cur%20"), F.col("page_no") + 1)
    body = F.concat(F.lit('{"results":['), F.array_join("events.event", ","), F.lit('],"next":"'), next_url, F.lit('"}'))
    schema = (
        "results array<struct<distinct_id:string,event:string,timestamp:string,properties:map<string,string>>>, next string"
    )
    return pages.select(
        F.lit("p").alias("pull_id"), "page_no", F.lit(LANDED).alias("landed_at"), F.from_json(body, schema).alias("body")
    ).select("pull_id", "page_no", "landed_at", "body.*")


PRODUCT_SQL = """
prod AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS row_index,
  CASE event_type WHEN 'view' THEN '$pageview' WHEN 'signup' THEN '$session_start' WHEN 'click' THEN '$autocapture' ELSE '$pageleave' END AS name,
  CASE WHEN event_id % 10 = 7 THEN 'invalid' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS raw FROM events),
pe AS (SELECT *, sha256('d' || user_id || ':' || name || ':' || raw || ':' || row_index)[1:32] AS sid FROM prod
       WHERE user_id % 13 <> 0 AND name <> '$pageleave')"""


@query(
    "product_events",
    f"""WITH {PRODUCT_SQL} SELECT 'd' || user_id AS entity_id, sha256('posthog:' || sid) AS event_id, sid AS source_event_id, name[2:] AS event_type,
  CASE WHEN event_id % 10 = 7 THEN TIMESTAMP '2024-02-01' ELSE ts END AS "timestamp",
  '{{"session_id":"s' || (event_id % 977) || '","url":"https://x.example/' || (event_id % 50) || '"' ||
    CASE WHEN user_id % 3 = 0 THEN ',"utm_source":"news"' ELSE '' END || '}}' AS extra FROM pe""",
)
def product_events(spark, sf):
    rows = PE.product_events(product_pages(spark, sf))
    return rows.select("entity_id", "event_id", "source_event_id", "event_type", "timestamp", "extra")


@query("page_cursors", f"SELECT DISTINCT event_id // {PRODUCT_PAGE} AS page_no, 'cur ' || (event_id // {PRODUCT_PAGE} + 1) AS cursor FROM events")
def page_cursors(spark, sf):
    return PE.page_cursors(product_pages(spark, sf)).select("page_no", "cursor")


@query(
    "url_cursors",
    """SELECT page_id, nullif(regexp_extract(replace(url, '?page=', '?after='), '[?&]after=([^&#]*)', 1), '') AS cursor FROM pages""",
)
def url_cursors(spark, sf):
    url = F.replace(F.col("url"), F.lit("?page="), F.lit("?after="))
    return load(spark, sf, "pages").select("page_id", F.nullif(cursor_of(url), F.lit("")).alias("cursor"))

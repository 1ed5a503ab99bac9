import json
from datetime import datetime
from hashlib import sha256

from wayline.sources import product_events as PE
from wayline.sources import web_report as WR

LANDED = datetime(2024, 2, 1)
HEADERS = ["dateHourMinute", "eventName", "sessionId", "clientId", "pageLocation", "pageReferrer", "sessionSource", "sessionMedium"]


def page(offset, *rows, pull="p"):
    return (pull, offset, LANDED, [(h,) for h in HEADERS], [([(v,) for v in row],) for row in rows], "9")


def digest(text):
    return sha256(text.encode()).hexdigest()


def test_report(spark):
    pages = spark.createDataFrame(
        [
            page(0, ["202401011200", "page_view", "sess_abc", "client_123", "https://e/l", "https://g", "google", "organic"],
                 ["202401011201", "scroll", "s", "client_123", "", "", "", ""]),
            page(2, ["202413011230", "session_start", "", "client_2", "", "", "", ""],
                 ["202401011230", "session_start", "s", "", "", "", "", ""],
                 ["short", "first_visit", "s", "client_3", "", "", "", ""]),
        ],
        WR.PAGE_SCHEMA,
    )
    rows = {r.entity_id: r for r in WR.report_events(pages).collect()}
    assert sorted(rows) == ["client_123", "client_2", "client_3"]
    first = rows["client_123"]
    assert (first.event_type, first.entity_type, first.event_category) == ("pageview", "device_id", "acquisition")
    assert first.timestamp == datetime(2024, 1, 1, 12)
    assert json.loads(first.extra) == {
        "session_id": "sess_abc", "url": "https://e/l", "referrer": "https://g", "utm_source": "google", "utm_medium": "organic",
    }
    sid = digest("client_123:sess_abc:page_view:202401011200:0")[:32]
    assert first.source_event_id == sid and first.event_id == digest(f"ga4:{sid}")
    assert rows["client_2"].timestamp == LANDED and rows["client_2"].extra is None
    # dropped rows and earlier pages count in the row index
    assert rows["client_3"].source_event_id == digest("client_3:s:first_visit:short:4")[:32]


def test_product_events(spark):
    def row(user, name, ts, **props):
        return (user, name, ts, props)

    props = {"$session_id": "s", "$current_url": "https://e/l", "$referrer": "", "utm_source": "google"}
    pages = spark.createDataFrame(
        [
            ("p", 0, LANDED, [row("user_123", "$pageview", "2024-01-15T12:00:00.000000Z", **props), row("user_123", "$pageleave", "x"),
                              row("", "$pageview", "x")], "https://p/api?limit=1&after=cursor_abc"),
            ("p", 1, LANDED, [row("u2", "$autocapture", "2024-01-15T14:00:00+02:00"), row("u3", "$session_start", "invalid")], None),
        ],
        PE.PAGE_SCHEMA,
    )
    rows = {r.entity_id: r for r in PE.product_events(pages).collect()}
    assert sorted(rows) == ["u2", "u3", "user_123"]
    assert json.loads(rows["user_123"].extra) == {"session_id": "s", "url": "https://e/l", "utm_source": "google"}
    assert rows["user_123"].timestamp == rows["u2"].timestamp == datetime(2024, 1, 15, 12)
    assert rows["u3"].timestamp == LANDED
    assert rows["u3"].source_event_id == digest("u3:$session_start:invalid:4")[:32]
    assert {r.page_no: r.cursor for r in PE.page_cursors(pages).collect()} == {0: "cursor_abc", 1: None}

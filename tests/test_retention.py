"""Cohorts by week and by acquisition channel."""

from pyspark.sql import functions as F

from tests.helpers import at, event, events
from wayline.operators.funnel import cohort_retention
from wayline.schema import extra_value


def test_a_cohort_is_the_channel_of_the_first_touch(spark):
    def touch(i, entity, day, kind="view", channel=None):
        return event(i, kind, day, entity=entity, extra=f'{{"utm": "{channel}"}}' if channel else None)

    df = events(
        spark,
        touch("b", "u1", "2024-01-02", channel="ads"), touch("c", "u1", "2024-01-03", channel="mail"), touch("d", "u1", "2024-01-09", "buy"),
        touch("f", "u2", "2024-01-02", channel="ads"), touch("e", "u2", "2024-01-02", channel="mail"), touch("g", "u2", "2024-01-02", "buy"),
        touch("h", "u3", "2024-01-03"), touch("i", "u3", "2024-01-16", "buy"),
        touch("j", "u4", "2024-01-03", channel="ads"),
    )
    rows = cohort_retention(df, "buy", channel=extra_value("utm")).collect()
    got = {(r.cohort_week, r.channel, r.week_no): (r.n_active, r.cohort_size, r.share) for r in rows}
    week = at("2024-01-01")
    # of two first events at one time the smaller id tells; an unknown channel is a cohort too
    assert got == {(week, "ads", 1): (1, 2, 0.5), (week, "mail", 0): (1, 1, 1.0), (week, None, 2): (1, 1, 1.0)}
    plain = {(r.week_no): (r.n_active, r.cohort_size) for r in cohort_retention(df, "buy").collect()}
    assert plain == {0: (1, 4), 1: (1, 4), 2: (1, 4)}
    assert cohort_retention(df.limit(0), channel=F.col("chain")).collect() == []

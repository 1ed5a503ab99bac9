"""As-of join and running total that stay even when one key holds most rows."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayline.functions.scalars import seconds
from wayline.session import materialize

SLICE_ROWS = 1_000_000
BROADCAST_ROWS = 100_000  # counted before a broadcast, a shuffled join beyond
CELLS = 65_536


def _cell(on: list[str]) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(CELLS)).cast("int")


def crowded_cells(rows: DataFrame, on: list[str], most: int) -> list[int]:
    """Hash cells of keys that hold more than ``most`` rows: no key of another cell does.

    Rows are counted by cell, so a task shuffles a row a cell, however many keys there are.
    """
    counts = rows.select(_cell(on).alias("cell")).groupBy("cell").count()
    return sorted(r["cell"] for r in counts.where(F.col("count") > most).collect())


def in_cells(on: list[str], cells: list[int]) -> Column:
    return _cell(on).isin(cells)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_ts: str,
    right_ts: str,
    values: list[str],
    *,
    newest_by: str | None = None,
    tolerance: timedelta | float | None = None,
    bucket: timedelta | float = timedelta(hours=1),
    slice_rows: int = SLICE_ROWS,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Each left row with ``values`` of the latest right row at or before it.

    Every left row comes out exactly once; the values are null when no right
    row matches, when a key is null, or when the match is older than
    ``tolerance``.  Right rows of one key and time count once: the one with the
    greatest ``newest_by``, then the greatest values.  ``facts`` are columns of a
    key, one row each, which its left rows take along: they travel with the right
    rows, so that left rows aren't shuffled a second time for them.

    Rows are counted first, by hash cell of the key, and by key within a crowded
    cell only.  A key with at most ``slice_rows`` rows is one window group, after
    one shuffle.  A window over a crowded key would put it into one task, so its
    time is cut into buckets, and a bucket into as many slices as its left rows
    need:

    1. count the left rows per (key, bucket) and take the last right row per
       (key, bucket), both by partial aggregation;
    2. over that small grid, at most one row per key and bucket, carry the last
       right row forward: what a bucket starts with;
    3. the starting rows, the bucket's right rows and the facts go to each of its slices.

    A slice is chosen by row hash and map partition, so identical copies of one
    row spread too, and a retried task places its rows as before.  The counts
    and the grid are written to the shared folder: building the plan runs them.
    """
    newest = F.struct(
        *([F.col(newest_by).alias("newest")] if newest_by else []),
        *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)],
    )
    usable = F.lit(True)
    for name in [*on, right_ts]:
        usable = usable & F.col(name).isNotNull()
    right = right.where(usable).select(
        *on, F.col(right_ts).alias("__at"), F.struct(F.col(right_ts).alias("ts"), newest.alias("pick")).alias("__state")
    )
    told = [] if facts is None else [c for c in facts.columns if c not in on]
    if facts is not None:
        known = reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in on])
        facts = facts.where(known).select(*on, F.struct(*told).alias("__fact"))
    # key and time travel once, beside the rest of the row
    apart = {**{name: name for name in on}, left_ts: "__at"}
    rest = [c for c in left.columns if c not in apart] or left.columns
    rows = left.select(*on, F.col(left_ts).alias("__at"), F.struct(*rest).alias("__row"))

    keys = left.select(*on).unionByName(right.select(*on))
    cells = crowded_cells(keys, on, slice_rows)
    n_crowded = 0
    if cells:
        sizes = keys.where(in_cells(on, cells)).groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
        crowded = materialize(sizes.where(F.col("__n") > slice_rows).select(*on), "asof-crowded")
        n_crowded = crowded.count()
    if n_crowded == 0:
        place, states = [], right
    else:
        place = ["__bucket", "__slice"]
        rows, states, facts = _cut(rows, right, facts, on, crowded, n_crowded, int(seconds(bucket) * 1_000_000), slice_rows)

    along = (
        W.partitionBy(*on, *place)
        .orderBy("__at", "__kind", "__state")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    found = rows.withColumn("__kind", F.lit(1)).unionByName(
        states.withColumn("__kind", F.lit(0)), allowMissingColumns=True
    )
    carried = {"__found": F.last("__state", ignorenulls=True).over(along)}
    if facts is not None:  # without a time, they come before all rows of the key
        found = found.unionByName(facts.withColumn("__kind", F.lit(0)), allowMissingColumns=True)
        carried["__fact"] = F.last("__fact", ignorenulls=True).over(along)
    found = found.withColumns(carried).where(F.col("__kind") == 1)
    fresh = F.lit(True)
    if tolerance is not None:
        limit = int(seconds(tolerance) * 1_000_000)
        fresh = F.unix_micros("__at") - F.unix_micros("__found.ts") <= limit
    picked = [F.col("__found.ts").alias(right_ts)]
    picked += [F.col(f"__found.pick.v{i}").alias(v) for i, v in enumerate(values)]
    if tolerance is not None:
        found = found.withColumn("__found", F.when(fresh, F.col("__found")))
    whole_row = [F.col(f"__row.`{c}`" if c in rest else apart[c]).alias(c) for c in left.columns]
    return found.select(*whole_row, *picked, *[F.col(f"__fact.`{c}`").alias(c) for c in told])


def _look_up(df: DataFrame, small: DataFrame, n_rows: int, keys: list[str]) -> DataFrame:
    """Left join with a counted table on null-safe keys; its key columns are dropped."""
    renamed = small.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in small.columns if c not in keys], F.lit(True).alias("__hit")
    )
    if n_rows <= BROADCAST_ROWS:
        renamed = F.broadcast(renamed)
    match = F.lit(True)
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"__k_{key}"))
    return df.join(renamed, match, "left").drop(*[f"__k_{k}" for k in keys])


def _cut(
    rows: DataFrame,
    right: DataFrame,
    facts: DataFrame | None,
    on: list[str],
    crowded: DataFrame,
    n_crowded: int,
    width: int,
    slice_rows: int,
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Buckets and slices of the crowded keys; other keys stay whole."""
    micros = F.unix_micros("__at")
    bucket = F.when(F.col("__hit"), micros - F.pmod(micros, F.lit(width))).otherwise(F.lit(0))

    def marked(df: DataFrame) -> DataFrame:
        hit = _look_up(df, crowded, n_crowded, on)
        return hit.withColumn("__bucket", bucket).withColumn("__cut", F.col("__hit").isNotNull()).drop("__hit")

    cell = [*on, "__bucket"]
    rows, right = marked(rows), marked(right)
    # right rows of one key and time count once
    series = right.where("__cut").groupBy(*cell, "__at").agg(F.max("__state").alias("__state"))
    needed = rows.where("__cut").groupBy(*cell).agg(F.count(F.lit(1)).alias("__rows"))
    closing = series.groupBy(*cell).agg(F.max("__state").alias("__close"))
    grid = (
        needed.unionByName(closing, allowMissingColumns=True)
        .groupBy(*cell)
        .agg(F.max("__rows").alias("__rows"), F.max("__close").alias("__close"))
    )
    before = W.partitionBy(*on).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    grid = materialize(
        grid.withColumn("__opening", F.last("__close", ignorenulls=True).over(before))
        .where(F.col("__rows").isNotNull())
        .select(*cell, F.ceil(F.col("__rows") / F.lit(slice_rows)).cast("int").alias("__slices"), "__opening"),
        "asof-grid",
    )
    openings = grid.where(F.col("__opening").isNotNull()).select(
        *cell, "__slices", F.col("__opening.ts").alias("__at"), F.col("__opening").alias("__state")
    )
    inside = series.join(grid.select(*cell, "__slices"), cell).select(*openings.columns)
    each_slice = F.explode(F.sequence(F.lit(0), F.col("__slices") - 1))
    states = openings.unionByName(inside).withColumn("__slice", each_slice)
    if facts is not None:
        others = _look_up(facts, crowded, n_crowded, on).where(F.col("__hit").isNull()).drop("__hit")
        others = others.withColumns({"__bucket": F.lit(0).cast("bigint"), "__slice": F.lit(0)})
        facts = facts.join(grid.select(*cell, "__slices"), on).withColumn("__slice", each_slice)
        facts = facts.select(*cell, "__slice", "__fact").unionByName(others)
    whole = right.where(~F.col("__cut")).withColumn("__slice", F.lit(0))
    columns = [*cell, "__slice", "__at", "__state"]

    # only cells with several slices are looked up
    sliced = grid.where(F.col("__slices") > 1).select(*cell, "__slices")
    spread = F.xxhash64(F.spark_partition_id(), "__row")
    rows = _look_up(rows.withColumn("__spread", spread), sliced, sliced.count(), cell).withColumn(
        "__slice", F.coalesce(F.pmod(F.col("__spread"), F.col("__slices")).cast("int"), F.lit(0))
    )
    rows = rows.drop("__spread", "__slices", "__hit", "__cut")
    return rows, states.select(*columns).unionByName(whole.select(*columns)), facts


def running_offset(
    df: DataFrame, group: list[str], position: str, amount: str, result: str, *, block: int = 10_000
) -> DataFrame:
    """Sum of ``amount`` over the rows of the group with a smaller ``position``.

    ``position`` is a whole number, unique in the group.  The group is summed in
    blocks of positions first, so no task sees more than one block of a group
    or the list of its block totals.
    """
    blocked = df.withColumn("__block", F.floor(F.col(position) / F.lit(block)))
    totals = blocked.groupBy(*group, "__block").agg(F.sum(amount).alias("__total"))
    earlier = W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        *group,
        "__block",
        F.coalesce(F.sum("__total").over(earlier.partitionBy(*group)), F.lit(0)).alias("__start"),
    )
    inside = W.partitionBy(*group, "__block").orderBy(position).rowsBetween(W.unboundedPreceding, -1)
    return (
        blocked.withColumn("__inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(starts, [*group, "__block"])
        .withColumn(result, F.col("__start") + F.col("__inside"))
        .drop("__block", "__inside", "__start")
    )

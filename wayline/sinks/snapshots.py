"""Tables that a re-run leaves as they are: month folders named by a manifest, swapped in one rename.

A table is a folder with `data/run=<id>/<month column>=<month>/` files and `_manifests/` of
numbered versions. A manifest lists the month folders that are the table, each with its rows and
the ranges of a few columns: a read of a range of them lists only the folders that meet it. A write puts files into folders of its own run first; the table
changes only when the next manifest gets its name, by a rename that fails if another writer took
that number. So a job lost anywhere before leaves the old table, readers of an old version keep
its files, and a writer that lost the race runs its join again on what the other one wrote.

`insert_new` looks for the batch's keys only in folders whose range meets the batch's own: a key
fixes the bound column (an event's id its time, a log's place its block). With a source that moves
a row's time, ask for `anywhere=True`, which reads the keys of all folders.

The driver sees the manifest (a line a month folder) and the ranges of the folders just written.
Every insert adds a folder to each month it touches; `compact` joins those of a month and
`expire` removes what no kept version names.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.operators.enrich import apply_updates
from wayline.session import materialize
from wayline.sinks.layout import LAYOUT, laid_out, with_options

#: What makes a row of a table one, and the column whose ranges prune the search for it.
KEYS = {
    "canonical_events": (["event_id"], "timestamp"),
    "canonical_logs": (["source_system", "chain", "tx_hash", "log_index"], "block_number"),
    "bridge_links": (["link_key_type", "link_key", "src_event_id"], "src_block_time"),
    "token_prices": (["chain", "token_address", "timestamp", "source"], "timestamp"),
    "entity_relationships": (["from_entity", "from_entity_type", "relationship_type", "to_entity", "to_entity_type"], None),
    "token_metadata": (["chain", "token_address"], None),
    "anchor_index": (["entity_id", "event_id", "batch"], "batch"),
}
#: Columns whose ranges the manifest holds besides.
RANGED = {
    "canonical_events": ["block_number"],
    "canonical_logs": ["block_time"],
    "bridge_links": ["dst_block_time"],
}
ATTEMPTS = 5


class Conflict(Exception):
    """Another writer took the version."""


@dataclass(frozen=True)
class Part:
    """One month folder; column → lowest and highest value as whole numbers (microseconds of times)."""

    folder: str
    month: str | None
    rows: int
    ranges: dict[str, list[int | None]]


@dataclass(frozen=True)
class Manifest:
    version: int
    table: str
    schema: T.StructType | None
    parts: tuple[Part, ...]

    def text(self) -> str:
        schema = self.schema.jsonValue() if self.schema else None
        return json.dumps({"table": self.table, "schema": schema, "parts": [asdict(p) for p in self.parts]})


# files, through the cluster's own file system


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _fs(spark, f"{path}/_manifests")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def is_snapshot_table(spark: SparkSession, path: str) -> bool:
    fs, folder = _fs(spark, f"{path}/_manifests")
    return fs.exists(folder)


def manifest(spark: SparkSession, path: str, table: str = "", version: int | None = None) -> Manifest:
    """The named or newest version; version 0 is the empty table before the first write."""
    if version is None:
        version = max(_versions(spark, path), default=0)
    if version == 0:
        return Manifest(0, table, None, ())
    fs, file = _fs(spark, f"{path}/_manifests/v{version:010d}.json")
    stream = fs.open(file)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    found = json.loads(text)
    schema = T.StructType.fromJson(found["schema"]) if found["schema"] else None
    return Manifest(version, found["table"], schema, tuple(Part(**p) for p in found["parts"]))


def _commit(spark: SparkSession, path: str, new: Manifest) -> None:
    jvm = spark._jvm
    fs, target = _fs(spark, f"{path}/_manifests/v{new.version:010d}.json")
    _, draft = _fs(spark, f"{path}/_manifests/.draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(new.text().encode()))
    finally:
        stream.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark._sc._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        files.rename(fs.makeQualified(draft), fs.makeQualified(target), options)
    except Exception as error:
        fs.delete(draft, False)
        if fs.exists(target):
            raise Conflict(f"version {new.version} of {path} is taken") from error
        raise


# reading


def _whole(column: Column, kind: T.DataType) -> Column:
    """The bound column as a whole number."""
    return F.unix_micros(column) if isinstance(kind, T.TimestampType) else column.cast("long")


Range = tuple[datetime | int | None, datetime | int | None]


def read(spark: SparkSession, path: str, version: int | None = None, **ranges: Range) -> DataFrame:
    """The table as of a version. Ranges of columns are closed, None leaves an end open; where the
    manifest knows a column, only the folders that meet its range are listed."""
    found = manifest(spark, path, version=version)
    numbers = {c: (_number(spark, low), _number(spark, high)) for c, (low, high) in ranges.items()}
    rows = _frame(spark, path, found, [p for p in found.parts if all(_meets(p, c, *n) for c, n in numbers.items())])
    for column, (low, high) in ranges.items():
        rows = rows if low is None else rows.where(F.col(column) >= F.lit(low))
        rows = rows if high is None else rows.where(F.col(column) <= F.lit(high))
    return rows


def _number(spark: SparkSession, value: datetime | int | None) -> int | None:
    if isinstance(value, datetime):  # as a literal is, so that both mean the same moment
        return spark.sql("SELECT 1").select(F.unix_micros(F.lit(value))).first()[0]
    return value


def _meets(part: Part, column: str | None, low: int | None, high: int | None) -> bool:
    """Whether the folder may have rows in the range. One that has no value in the column has none."""
    if (low is None and high is None) or column not in part.ranges:
        return True
    first, last = part.ranges[column]
    if first is None or last is None:
        return False
    return (low is None or last >= low) and (high is None or first <= high)


def _frame(spark: SparkSession, path: str, of: Manifest, parts: list[Part]) -> DataFrame:
    if of.schema is None:
        raise ValueError(f"{path} has no version yet")
    if not parts:
        return spark.createDataFrame([], of.schema)
    rows = spark.read.schema(of.schema).option("basePath", f"{path}/data").parquet(*[f"{path}/data/{p.folder}" for p in parts])
    return rows.select(*[f"`{n}`" for n in of.schema.fieldNames()])


# writing


def _store(spark: SparkSession, rows: DataFrame, path: str, table: str) -> tuple[T.StructType, list[Part]]:
    """Rows in folders of a run of their own, which no manifest names yet."""
    month, source, _ = LAYOUT[table]
    run = f"run={uuid.uuid4().hex}"
    placed = laid_out(rows.drop(month) if month and month in rows.columns else rows, table)
    writer = with_options(placed.write, table)
    if month is not None:
        writer = writer.partitionBy(month)
    writer.parquet(f"{path}/data/{run}")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in placed.schema])
    back = spark.read.schema(schema).parquet(f"{path}/data/{run}")
    ranged = [*filter(None, [KEYS[table][1]]), *RANGED.get(table, [])]
    ends = []
    for i, column in enumerate(ranged):
        value = _whole(F.col(column), schema[column].dataType)
        ends += [F.min(value).alias(f"low{i}"), F.max(value).alias(f"high{i}")]
    of = F.col(month) if month else F.lit(None).cast("date")
    parts = []
    for r in back.groupBy(of.alias("month")).agg(F.count(F.lit(1)).alias("n"), *ends).collect():  # a row a month
        name = run if month is None else f"{run}/{month}={r['month'] or '__HIVE_DEFAULT_PARTITION__'}"
        ranges = {c: [r[f"low{i}"], r[f"high{i}"]] for i, c in enumerate(ranged)}
        parts.append(Part(name, str(r["month"]) if r["month"] else None, r["n"], ranges))
    return schema, sorted(parts, key=lambda p: p.folder)


def _merged(old: T.StructType | None, new: T.StructType) -> T.StructType:
    """All columns of both: a column that only some folders have reads as null in the others."""
    known = old.fieldNames() if old else []
    return T.StructType([*(old.fields if old else []), *[f for f in new.fields if f.name not in known]])


def _attempt(spark: SparkSession, path: str, table: str, step: Callable[[Manifest], tuple[Manifest, int] | None]) -> int:
    """Run a step on the newest version until its own version is taken by no other."""
    for left in reversed(range(ATTEMPTS)):
        done = step(manifest(spark, path, table))
        if done is None:
            return 0
        try:
            _commit(spark, path, done[0])
            return done[1]
        except Conflict:
            if not left:
                raise
            time.sleep(0.1)
    return 0


def _range(rows: DataFrame, table: str) -> tuple[int | None, int | None, bool]:
    """Range of the bound column, and whether it is null in any row."""
    bound = KEYS[table][1]
    if bound is None:
        return None, None, True
    value = _whole(F.col(bound), rows.schema[bound].dataType)
    return tuple(rows.agg(F.min(value), F.max(value), F.coalesce(F.bool_or(value.isNull()), F.lit(False))).first())


def _same_key(table: str, left: DataFrame, right: DataFrame) -> Column:
    condition = F.lit(True)
    for key in KEYS[table][0]:
        condition = condition & left[key].eqNullSafe(right[f"__{key}"])
    return condition


def _keys_of(rows: DataFrame, table: str) -> DataFrame:
    return rows.select(*[F.col(k).alias(f"__{k}") for k in KEYS[table][0]])


def insert_new(rows: DataFrame, path: str, table: str, anywhere: bool = False) -> int:
    """Add the rows whose key the table doesn't have, one for each key, and return how many."""
    spark = rows.sparkSession
    batch = materialize(rows.dropDuplicates(KEYS[table][0]), "batch")
    low, high, unknown = _range(batch, table)

    def step(old: Manifest) -> tuple[Manifest, int] | None:
        new = batch
        near = list(old.parts) if anywhere or unknown else [p for p in old.parts if _meets(p, KEYS[table][1], low, high)]
        if near:
            stored = _frame(spark, path, old, near)
            if not (anywhere or unknown):  # the same range again, for row groups
                bound = KEYS[table][1]
                value = F.timestamp_micros if isinstance(stored.schema[bound].dataType, T.TimestampType) else (lambda x: x)
                stored = stored.where(F.col(bound).between(value(F.lit(low)), value(F.lit(high))))
            stored = _keys_of(stored, table)
            new = batch.join(stored, _same_key(table, batch, stored), "left_anti")
        schema, parts = _store(spark, new, path, table)
        if not parts and old.version:
            return None
        return Manifest(old.version + 1, table, _merged(old.schema, schema), (*old.parts, *parts)), sum(p.rows for p in parts)

    return _attempt(spark, path, table, step)


def rewrite(spark: SparkSession, path: str, table: str, touched: Callable[[Part], bool], change: Callable[[DataFrame], DataFrame], add: DataFrame | None = None) -> int:
    """Put changed rows in place of the folders that are touched; returns the rows written."""

    def step(old: Manifest) -> tuple[Manifest, int] | None:
        gone = [p for p in old.parts if touched(p)]
        rows = change(_frame(spark, path, old, gone)) if gone else None
        if add is not None:
            rows = add if rows is None else rows.unionByName(add, allowMissingColumns=True)
        if rows is None:
            return None
        schema, parts = _store(spark, rows, path, table)
        kept = [p for p in old.parts if not touched(p)]
        return Manifest(old.version + 1, table, _merged(old.schema, schema), (*kept, *parts)), sum(p.rows for p in parts)

    return _attempt(spark, path, table, step)


def upsert(rows: DataFrame, path: str, table: str, anywhere: bool = False) -> int:
    """Put the rows in the place of those with their keys, one for each key, and return how many."""
    spark = rows.sparkSession
    batch = materialize(rows.dropDuplicates(KEYS[table][0]), "batch")
    n = batch.count()
    if not n and _versions(spark, path):
        return 0
    low, high, unknown = _range(batch, table)

    def change(stored: DataFrame) -> DataFrame:
        keys = _keys_of(batch, table)
        month = LAYOUT[table][0]
        return (stored.drop(month) if month else stored).join(keys, _same_key(table, stored, keys), "left_anti")

    rewrite(spark, path, table, lambda p: anywhere or unknown or _meets(p, KEYS[table][1], low, high), change, batch)
    return n


def write_back(spark: SparkSession, path: str, updates: DataFrame) -> int:
    """Fill enrichment updates into the stored events: months an update touches are written anew, then swapped at once."""
    n = updates.select("event_id").distinct().count()
    found = manifest(spark, path, "canonical_events")
    if not n or not found.parts:
        return n
    events = _frame(spark, path, found, list(found.parts))
    months = {str(r[0]) for r in events.join(updates.select("event_id"), "event_id", "left_semi").select("event_month").distinct().collect()}
    rewrite(spark, path, "canonical_events", lambda p: str(p.month) in months, lambda rows: apply_updates(rows.drop("event_month"), updates))
    return n


def compact(spark: SparkSession, path: str, most: int = 1) -> int:
    """Join the folders of each month that has more than `most`; returns how many months."""
    folders: dict[str | None, int] = {}
    found = manifest(spark, path)
    for p in found.parts:
        folders[p.month] = folders.get(p.month, 0) + 1
    many = {m for m, n in folders.items() if n > most}
    if many:
        rewrite(spark, path, found.table, lambda p: p.month in many, lambda rows: rows)
    return len(many)


def expire(spark: SparkSession, path: str, keep: int = 10, older_than_seconds: float = 86_400) -> int:
    """Remove old versions and the run folders that no kept version names and that are old enough
    not to belong to a write under way; returns how many run folders went."""
    versions = _versions(spark, path)
    kept = versions[-keep:] if keep else versions[-1:]
    used = {p.folder.split("/")[0] for v in kept for p in manifest(spark, path, version=v).parts}
    fs, data = _fs(spark, f"{path}/data")
    removed = 0
    before = (time.time() - older_than_seconds) * 1000
    for status in fs.listStatus(data) if fs.exists(data) else []:
        if status.getPath().getName() not in used and status.getModificationTime() <= before:
            removed += bool(fs.delete(status.getPath(), True))
    for v in versions[: -len(kept)] if kept else []:
        fs.delete(_fs(spark, f"{path}/_manifests/v{v:010d}.json")[1], False)
    return removed

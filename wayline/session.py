"""Session settings and the few helpers that need a SparkSession."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Runtime settings every plan in this package is written for: sizes are decided
# from shuffle statistics and hot join partitions are split.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join partition even when the split costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def constant_frame(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """A frame for a fixed, in-code list of rows.

    Going through Arrow gives Catalyst a local relation whose size it knows, so
    it broadcasts it by its own size check and no hint is needed.
    """
    names = schema.fieldNames()
    filled = [{name: row.get(name) for name in names} for row in rows]
    table = pa.Table.from_pylist(filled, schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema=schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return tempfile.mkdtemp(prefix="spark-")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Its readers then share one computation, and Catalyst knows its size.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_TABLES: dict[tuple[str, str], DataFrame] = {}


def derived_table(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table written once per application, as its tasks give it, and read by every later use.

    For rows that cost a shuffle. A projection of a table is cheaper computed than written.
    """
    key = (spark.sparkContext.applicationId, name)
    if key not in _TABLES:
        _TABLES[key] = materialize(build(), name.strip("/").replace("/", "_"))
    return _TABLES[key]

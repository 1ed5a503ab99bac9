"""Where a table's rows lie: month folder, order within it, and what its files index."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from wayline.functions.scalars import month_of

# Partition column (a month), the time it comes from, and the sort key per table.
LAYOUT = {
    "canonical_events": ("event_month", "timestamp", ["entity_id", "timestamp"]),
    "canonical_logs": ("log_month", "inserted_at", ["block_number", "log_index"]),
    "bridge_links": ("link_month", "src_block_time", ["link_key_type", "link_key", "src_chain", "dst_chain"]),
    "token_prices": ("price_month", "timestamp", ["chain", "token_address", "timestamp"]),
    "entity_relationships": (None, None, ["from_entity", "relationship_type", "to_entity"]),
    "token_metadata": (None, None, ["chain", "token_address"]),
    "anchor_index": (None, None, ["entity_id", "event_id"]),
}

#: Columns asked for by value that the order of the rows doesn't serve: files hold a Bloom filter of each.
BLOOM = {
    "canonical_events": ["entity_id", "event_id", "tx_hash"],
    "canonical_logs": ["topic0", "address", "tx_hash"],
    "bridge_links": ["link_key", "src_entity_id", "dst_entity_id"],
}


def laid_out(df: DataFrame, table: str) -> DataFrame:
    """Rows placed and sorted for the table.

    Range partitioning on (month, sort key): files hold narrow key ranges, so a
    query for one entity reads few of them, and an entity with very many events
    spreads over several files, which hashing on the entity would not allow.
    """
    month, source, keys = LAYOUT[table]
    if month is None:
        return df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    df = df.withColumn(month, month_of(F.col(source)))
    return df.repartitionByRange(month, *keys).sortWithinPartitions(month, *keys)


def with_options(writer: DataFrameWriter, table: str) -> DataFrameWriter:
    writer = writer.option("compression", "zstd")
    for column in BLOOM.get(table, []):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    return writer

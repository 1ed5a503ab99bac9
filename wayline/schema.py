"""Table schemas and the two null conventions (stored '' and NULL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_AMOUNT = T.DecimalType(38, 0)
USD = T.DecimalType(38, 6)
PRICE = T.DecimalType(38, 18)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _L, _TS = T.StringType(), T.LongType(), T.TimestampType()

CANONICAL_EVENTS = _struct(
    entity_id=_S,
    entity_type=_S,
    event_id=_S,
    event_type=_S,
    event_category=_S,
    timestamp=_TS,
    source_system=_S,
    source_event_id=_S,
    chain=_S,
    block_number=_L,
    block_time=_TS,
    tx_hash=_S,
    log_index=_L,
    protocol=_S,
    venue=_S,
    token_in=_S,
    token_out=_S,
    amount_in=RAW_AMOUNT,
    amount_out=RAW_AMOUNT,
    amount_in_usd=USD,
    amount_out_usd=USD,
    counterparty=_S,
    aggregator=_S,
    link_key=_S,
    link_key_type=_S,
    extra=_S,
)

EVENT_COLUMNS = CANONICAL_EVENTS.fieldNames()

# uint256 amounts need up to 78 digits, DECIMAL holds 38: the exact digits stay
# beside the events as text and the DECIMAL is NULL when they do not fit.
EXACT_AMOUNTS = ["amount_in_raw", "amount_out_raw"]

CANONICAL_LOGS = _struct(
    source_system=_S,
    chain=_S,
    block_number=_L,
    block_time=_TS,
    tx_hash=_S,
    log_index=_L,
    address=_S,
    topic0=_S,
    topic1=_S,
    topic2=_S,
    topic3=_S,
    data=_S,
    decoded=T.ShortType(),
    decoder_version=_L,
    inserted_at=_TS,
)

ENTITY_RELATIONSHIPS = _struct(
    from_entity=_S,
    from_entity_type=_S,
    to_entity=_S,
    to_entity_type=_S,
    relationship_type=_S,
    confidence_score=T.DoubleType(),
    source=_S,
    detected_at=_TS,
    expires_at=_TS,
)

BRIDGE_LINKS = _struct(
    link_key=_S,
    link_key_type=_S,
    src_chain=_S,
    src_block_time=_TS,
    src_tx_hash=_S,
    src_entity_id=_S,
    src_event_id=_S,
    dst_chain=_S,
    dst_block_time=_TS,
    dst_tx_hash=_S,
    dst_entity_id=_S,
    dst_event_id=_S,
    token=_S,
    amount=RAW_AMOUNT,
    amount_usd=USD,
    link_confidence=T.DoubleType(),
    validated_at=_TS,
)

TOKEN_METADATA = _struct(
    token_address=_S,
    chain=_S,
    symbol=_S,
    decimals=T.IntegerType(),
    name=_S,
    inserted_at=_TS,
)

TOKEN_PRICES = _struct(
    token_address=_S,
    chain=_S,
    timestamp=_TS,
    price_usd=PRICE,
    source=_S,
    volume_24h_usd=T.DecimalType(38, 2),
    inserted_at=_TS,
)

ENRICHMENT_UPDATES = _struct(amount_in_usd=USD, amount_out_usd=USD, event_id=_S)

# Columns the store keeps as '' instead of NULL, and those read back as NULL.
STORED_AS_EMPTY = [
    "entity_id",
    "entity_type",
    "event_id",
    "event_type",
    "event_category",
    "source_system",
    "source_event_id",
    "chain",
    "protocol",
    "venue",
    "aggregator",
]
READ_AS_NULL = ["chain", "protocol", "venue", "aggregator"]


def conform(df: DataFrame, schema: T.StructType, keep: list[str] | None = None) -> DataFrame:
    """Exactly the columns of ``schema`` in order, missing ones null, plus ``keep``."""
    present = set(df.columns)
    columns = [
        f"CAST({f'`{f.name}`' if f.name in present else 'NULL'} AS {f.dataType.simpleString()}) AS `{f.name}`"
        for f in schema.fields
    ]
    columns += [f"`{name}`" for name in keep or [] if name in present]
    return df.selectExpr(*columns)


def to_storage_nulls(events: DataFrame) -> DataFrame:
    """Write rule: null becomes '' on eleven text columns and '{}' in ``extra``."""
    changes = {name: F.coalesce(F.col(name), F.lit("")) for name in STORED_AS_EMPTY}
    changes["extra"] = F.coalesce(F.col("extra"), F.lit("{}"))
    return events.withColumns(changes)


def from_storage_nulls(events: DataFrame) -> DataFrame:
    """Read rule: '' becomes null on four columns, unreadable ``extra`` becomes null."""
    changes = {name: F.nullif(F.col(name), F.lit("")) for name in READ_AS_NULL}
    changes["extra"] = F.when(extra_map("extra").isNotNull(), F.col("extra"))
    for name in ("amount_in", "amount_out"):
        changes[name] = F.col(name).try_cast(RAW_AMOUNT)
    for name in ("amount_in_usd", "amount_out_usd"):
        changes[name] = F.col(name).try_cast(USD)
    return events.withColumns(changes)


def extra_map(column: str | Column = "extra") -> Column:
    """The JSON text as MAP<STRING,STRING>; null when empty or not a JSON object."""
    return F.from_json(column, T.MapType(T.StringType(), T.StringType()))


def extra_value(key: str, column: str = "extra") -> Column:
    """One property of the JSON text, null when absent."""
    return F.get_json_object(F.col(column), f"$['{key}']")

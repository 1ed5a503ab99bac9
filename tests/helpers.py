from datetime import datetime
from decimal import Decimal

from wayline.schema import CANONICAL_EVENTS

DEFAULTS = {
    "entity_type": "wallet",
    "event_category": "transaction",
    "source_system": "evm_base",
    "source_event_id": "tx:0",
    "chain": "base",
}


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def events(spark, *rows):
    """Canonical events from dicts, the rest defaulted."""
    names = CANONICAL_EVENTS.fieldNames()
    full = [{**DEFAULTS, **row} for row in rows]
    for row in full:
        row.update({k: Decimal(v) for k, v in row.items() if k.startswith("amount_") and v is not None})
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], CANONICAL_EVENTS)


def event(event_id, event_type, ts, entity="0xaaa", **more):
    return {"event_id": event_id, "event_type": event_type, "timestamp": at(ts), "entity_id": entity, **more}

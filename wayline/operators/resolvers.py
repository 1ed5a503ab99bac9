"""Resolvers that hold for a time: proxy to implementation, web client to wallet, social account to wallet.

A resolver is a table of intervals: an entity stands for another from ``valid_from`` on, until
``valid_to`` (null: still) or until a later interval of that entity begins, whichever is first. So
intervals may overlap as they are landed: the one that began last holds. Of two that begin
at once the greater ``to_entity`` holds, then the greater of the other columns.

Times are timestamps. A proxy's changes are known by block, so there blocks are the clock: block
``n`` is ``n`` seconds after the epoch (``at_block``).
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.operators.asof import asof_join

ENTITY = ["entity_type", "entity_id"]
FOUND = ["to_entity", "to_type", "relationship_type", "confidence", "source"]
INTERVALS = [*ENTITY, *FOUND, "valid_from", "valid_to"]


def at_block(block: Column | str) -> Column:
    """A block number on the clock of blocks."""
    return F.timestamp_seconds(block)


def _intervals(rows: DataFrame, entity: tuple[Column, Column], to: tuple[Column, Column], kind: tuple[str, float, str], since: Column, until: Column | None) -> DataFrame:
    relationship, confidence, source = kind
    return rows.select(
        entity[0].alias("entity_type"),
        entity[1].alias("entity_id"),
        to[0].alias("to_entity"),
        to[1].alias("to_type"),
        F.lit(relationship).alias("relationship_type"),
        F.lit(confidence).alias("confidence"),
        F.lit(source).alias("source"),
        since.alias("valid_from"),
        (F.lit(None).cast("timestamp") if until is None else until).alias("valid_to"),
    ).where((F.col("entity_id") != "") & (F.col("to_entity") != "") & F.col("valid_from").isNotNull())


def proxy_implementations(upgrades: DataFrame) -> DataFrame:
    """Intervals of landed upgrades ``(chain, proxy, implementation, block_number, log_index)``, on the clock of blocks.

    Of the upgrades in one block the last holds. A proxy is known by chain and address, ``chain:address``.
    """
    last = upgrades.groupBy("chain", F.lower("proxy").alias("proxy"), "block_number").agg(F.max_by(F.lower("implementation"), "log_index").alias("implementation"))
    proxy, target = (F.concat_ws(":", "chain", c) for c in ("proxy", "implementation"))
    return _intervals(last.where(F.col("implementation").isNotNull()), (F.lit("contract"), proxy), (target, F.lit("contract")), ("implemented_by", 1.0, "proxy"), at_block("block_number"), None)


def client_wallets(logins: DataFrame, source: str = "web", confidence: float = 0.9) -> DataFrame:
    """Intervals of landed logins ``(client_id, wallet, timestamp)``: a client stands for the wallet of its last login."""
    return _intervals(logins, (F.lit("client_id"), F.col("client_id")), (F.lower("wallet"), F.lit("wallet")), ("logged_in_as", confidence, source), F.col("timestamp"), None)


def account_wallets(verifications: DataFrame, account_type: str = "farcaster", confidence: float = 0.95) -> DataFrame:
    """Intervals of landed verifications ``(account_id, address, verified_at, removed_at)``, which end when removed."""
    account = (F.lit(account_type), F.col("account_id").cast("string"))
    return _intervals(verifications, account, (F.lower("address"), F.lit("wallet")), ("verified", confidence, account_type), F.col("verified_at"), F.col("removed_at"))


def _holds(at: Column) -> Column:
    return F.col("valid_to").isNull() | (at < F.col("valid_to"))


def mapping_at(intervals: DataFrame, at: datetime | Column) -> DataFrame:
    """What holds at one time, as a resolver for ``identity.resolve_batch``: one row an entity at most."""
    at = F.lit(at)
    begun = intervals.where(F.col("valid_from") <= at)
    latest = F.max(F.struct("valid_from", *FOUND, "valid_to")).alias("row")
    newest = begun.groupBy(*ENTITY).agg(latest).select(*ENTITY, "row.*")
    return newest.where(_holds(at)).select(*ENTITY, *FOUND)


def resolve_as_of(rows: DataFrame, intervals: DataFrame, time: str = "timestamp", bucket: timedelta = timedelta(hours=1)) -> DataFrame:
    """Every row with what its entity stood for at its own time: FOUND and ``valid_from``, null where nothing held.

    An as-of join, so an entity with very many rows or intervals is cut by time.
    """
    changes = intervals.select(*ENTITY, F.col("valid_from").alias("__since"), *FOUND, "valid_from", "valid_to")
    joined = asof_join(rows, changes, ENTITY, time, "__since", [*FOUND, "valid_from", "valid_to"], bucket=bucket)
    held = _holds(F.col(time))
    return joined.select(*[c for c in rows.columns], *[F.when(held, F.col(c)).alias(c) for c in [*FOUND, "valid_from"]])

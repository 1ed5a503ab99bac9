"""Token holdings: exact balances from transfers, and the wallets that hold a token.

A token amount is a 256-bit number and a sum of them is wider; decimals end at 38 digits. An amount
is cut into pieces of nine digits, the pieces are summed as whole numbers (with partial sums before
the shuffle), and carries are handed on once, on the one row that is left of a wallet and token.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO_ADDRESS = "0x" + "00" * 20
#: Digits of a piece, and pieces: 81 digits hold every 256-bit number.
DIGITS, PIECES = 9, 9

_CARRIED = """aggregate(reverse({0}), named_struct('carry', 0L, 'text', ''),
  (acc, x) -> named_struct(
    'carry', (x + acc.carry - pmod(x + acc.carry, {1}L)) div {1}L,
    'text', concat(lpad(cast(pmod(x + acc.carry, {1}L) as string), {2}, '0'), acc.text)))"""


def _pieces(digits: Column) -> Column:
    """Nine digits each, the highest first; null where the text is no whole number of that size."""
    padded = F.lpad(digits, DIGITS * PIECES, "0")
    whole = F.when(digits.rlike(f"^[0-9]{{1,{DIGITS * PIECES}}}$"), padded)
    return F.array(*[F.substring(whole, 1 + DIGITS * i, DIGITS).cast("long") for i in range(PIECES)])


def signed_text(pieces: str) -> Column:
    """The number that summed pieces stand for, as text without leading zeros."""
    base = 10**DIGITS

    def text(column: str) -> Column:
        carried = F.expr(_CARRIED.format(column, base, DIGITS))
        return F.regexp_replace(F.concat(carried["carry"].cast("string"), carried["text"]), "^0+(?!$)", "")

    is_negative = F.expr(_CARRIED.format(pieces, base, DIGITS))["carry"] < 0
    negated = F.concat(F.lit("-"), text(f"transform({pieces}, x -> -x)"))
    return F.when(is_negative, negated).otherwise(text(pieces))


def balances(transfers: DataFrame, as_of: datetime | Column | None = None) -> DataFrame:
    """chain, token_address, entity_id, balance (digits, signed), n_transfers of every wallet a transfer names.

    Transfers are decoded events: ``entity_id`` gives ``amount_out_raw`` (else ``amount_out``) of
    ``token_out`` to ``counterparty``. The zero address, which issues and burns, has no balance.
    Rows without a readable amount or token count nowhere; a wallet's transfer to itself changes
    nothing. A balance below zero means that earlier transfers are missing.
    """
    rows = transfers if as_of is None else transfers.where(F.col("timestamp") <= F.lit(as_of))
    amount = F.col("amount_out").cast("decimal(38,0)").cast("string")
    raw = F.coalesce("amount_out_raw", amount) if "amount_out_raw" in transfers.columns else amount
    side = lambda wallet, sign: F.struct(F.col(wallet).alias("entity_id"), F.lit(sign).cast("long").alias("sign"))
    moves = rows.where(F.col("token_out").isNotNull()).select(
        "chain",
        F.col("token_out").alias("token_address"),
        _pieces(raw).alias("pieces"),
        F.explode(F.array(side("entity_id", -1), side("counterparty", 1))).alias("side"),
    )
    moves = moves.where(F.col("side.entity_id").isNotNull() & (F.col("side.entity_id") != ZERO_ADDRESS) & F.get("pieces", F.lit(0)).isNotNull())
    sums = [F.sum(F.col("side.sign") * F.get("pieces", F.lit(i))).alias(f"p{i}") for i in range(PIECES)]
    held = moves.groupBy("chain", "token_address", F.col("side.entity_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("n_transfers"), *sums)
    held = held.withColumn("__pieces", F.array(*[F.col(f"p{i}") for i in range(PIECES)]))
    return held.select("chain", "token_address", "entity_id", signed_text("__pieces").alias("balance"), "n_transfers")


def holders(transfers: DataFrame, token: str, chain: str | None = None, at_least: int = 1, as_of: datetime | Column | None = None) -> DataFrame:
    """entity_id, balance of the wallets that hold so many units of a token; ``segment(holders=…)`` takes it."""
    rows = transfers.where(F.col("token_out") == token)
    rows = rows if chain is None else rows.where(F.col("chain") == chain)
    found = balances(rows, as_of)
    width = DIGITS * PIECES + 20
    enough = F.lpad("balance", width, "0") >= F.lit(str(at_least).zfill(width))
    return found.where(~F.col("balance").startswith("-") & enough).select("chain", "entity_id", "balance")

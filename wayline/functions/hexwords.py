"""Reading 32-byte words from 0x-prefixed hex text with built-in functions only.

A uint256 is exact here without any Python worker: the word is cut into four
64-bit parts, each read by ``conv``, and recombined in limbs of 18 decimal
digits, which keeps every intermediate inside DECIMAL(38,0).  The carries make
one limb depend on the one below, so each step is a lambda over the one before:
one nested expression would repeat itself until the generated code is refused,
and projections for all steps make a method too long for the JVM to compile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMB = 10**18
LIMBS = 4
NARROW = 31  # hex digits whose value always fits DECIMAL(38,0)


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def body(hex_text: Column | str) -> Column:
    """The digits after the 0x prefix."""
    return F.substring(_column(hex_text), 3, 2_000_000_000)


def word(data: Column | str, index: int) -> Column:
    """32-byte word ``index`` of the data as 64 hex digits, null when cut short."""
    digits = F.substring(_column(data), 3 + 64 * index, 64)
    return F.when(F.length(digits) == 64, digits)


def word_at(data: Column | str, byte_offset: Column) -> Column:
    """The 32-byte word that starts at a byte offset, null when cut short."""
    digits = _column(data).substr(byte_offset * 2 + 3, F.lit(64))
    return F.when(F.length(digits) == 64, digits)


def address(word_or_topic: Column | str) -> Column:
    """The last 20 bytes as a lower-case address."""
    return F.concat(F.lit("0x"), F.lower(F.right(_column(word_or_topic), F.lit(40))))


def small_int(hex_digits: Column | str) -> Column:
    """At most 15 significant hex digits (no prefix) as BIGINT."""
    return F.conv(_column(hex_digits), 16, 10).cast("bigint")


def prefixed_int(hex_text: Column | str) -> Column:
    """``0x…`` to BIGINT."""
    return small_int(body(hex_text))


def to_word(hex_digits: Column | str) -> Column:
    """Any number of hex digits as one 64-digit word; null when the value is wider."""
    significant = F.regexp_replace(_column(hex_digits), "^0+", "")
    return F.when(F.length(significant) <= 64, F.lpad(significant, 64, "0"))


def _part(word_column: str, index: int) -> str:
    """SQL for 64-bit part ``index`` (0 = lowest) of a 64-digit word."""
    return f"CAST(conv(substring({word_column}, {49 - 16 * index}, 16), 16, 10) AS DECIMAL(20, 0))"


def _limb_sum(parts: list[str], limb: int, increment: str | None) -> str:
    """SQL for what the four 64-bit parts add to one limb, before carries."""
    terms = [increment] if increment else []
    for index, part in enumerate(parts):
        weight = 2 ** (64 * index) // LIMB**limb
        if limb < LIMBS - 1:
            weight %= LIMB
        if weight:
            terms.append(part if weight == 1 else f"{part} * CAST({weight} AS DECIMAL(18, 0))")
    return f"CAST({' + '.join(terms)} AS DECIMAL(38, 0))"


def with_digits(
    df: DataFrame, words: dict[str, str], increments: dict[str, str] | None = None
) -> DataFrame:
    """Add the exact decimal digits of 64-digit hex words as text columns.

    ``words`` maps a new column to the column that holds its word; a null word
    gives null.  ``increments`` names, per new column, a 0/1 column added to the
    value: a negative int256 is its inverted word plus one.
    """
    increments = increments or {}
    return df.selectExpr("*", *[f"{_digits(word, increments.get(new))} AS `{new}`" for new, word in words.items()])


def _wide_digits(word: str, increment: str | None) -> str:
    """SQL for the digits of any word, by limbs.

    Each step is a lambda over the one value of the step before.
    """
    parts = {f"p{i}": _part(word, i) for i in range(4)} | {"more": increment or "0"}
    value = f"array({_struct(parts)})"
    sums = {f"s{limb}": _limb_sum([f"x.p{i}" for i in range(4)], limb, None if limb else "x.more") for limb in range(LIMBS)}
    value = f"transform({value}, x -> {_struct(sums)})"
    for limb in range(LIMBS - 1):
        low = f"x.s{limb} % CAST({LIMB} AS DECIMAL(20, 0))"
        step = {f"low{i}": f"x.low{i}" for i in range(limb)} | {f"low{limb}": low}
        step |= {f"s{i}": f"x.s{i}" for i in range(limb + 2, LIMBS)}
        step[f"s{limb + 1}"] = (
            f"CAST(x.s{limb + 1} + CAST((x.s{limb} - {low}) / CAST({LIMB} AS DECIMAL(20, 0)) AS DECIMAL(38, 0)) AS DECIMAL(38, 0))"
        )
        value = f"transform({value}, x -> {_struct(step)})"
    low = ", ".join(f"lpad(CAST(x.low{i} AS STRING), 18, '0')" for i in reversed(range(LIMBS - 1)))
    return f"transform({value}, x -> ltrim('0', concat(CAST(x.s{LIMBS - 1} AS STRING), {low})))[0]"


def _struct(values: dict[str, str]) -> str:
    return f"named_struct({', '.join(f'{name!r}, {value}' for name, value in values.items())})"


def _digits(word: str, increment: str | None) -> str:
    """SQL for the digits: 64-bit values by ``conv`` alone, those of up to 31 hex
    digits by one DECIMAL product, only the rest from the limbs."""
    added = f" + {increment}" if increment else ""
    short = f"conv(right({word}, 16), 16, 10)"
    if increment:
        short = f"if({increment} = 0, {short}, CAST({_part(word, 0)}{added} AS STRING))"
    narrow = f"CAST(CAST({_part(word, 1)} * CAST({2**64} AS DECIMAL(20, 0)) AS DECIMAL(38, 0)) + {_part(word, 0)}{added} AS STRING)"
    return (
        f"CASE WHEN {word} IS NULL THEN NULL WHEN startswith({word}, '{'0' * 48}') THEN {short} "
        f"WHEN startswith({word}, '{'0' * (64 - NARROW)}') THEN {narrow} ELSE {_wide_digits(word, increment)} END"
    )


def is_negative(hex64: Column | str) -> Column:
    """Sign bit of an int256 word."""
    return F.lower(F.left(_column(hex64), F.lit(1))) >= "8"


def inverted(hex64: Column | str) -> Column:
    """All bits flipped; plus one this is the magnitude of a negative int256."""
    return F.translate(F.lower(_column(hex64)), "0123456789abcdef", "fedcba9876543210")


def signed_digits(negative: Column, magnitude: Column) -> Column:
    return F.when(negative, F.concat(F.lit("-"), magnitude)).otherwise(magnitude)

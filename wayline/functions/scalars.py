"""Scalar expressions shared by the sources and operators."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stablecoin addresses and their symbols.
STABLECOINS = {
    "0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48": "USDC",
    "0xdac17f958d2ee523a2206206994597c13d831ec7": "USDT",
    "0x6b175474e89094c44da98b954eedeac495271d0f": "DAI",
    "0x4fabb145d64652a948d72533023f6e7a623c7c53": "BUSD",
}


def event_id(source_system: Column, source_event_id: Column) -> Column:
    """Identity of an event, the same on every re-ingest of the same source row."""
    return F.sha2(F.concat_ws(":", source_system, source_event_id), 256)


def short_hash(*parts: Column) -> Column:
    """First 32 hex digits over the parts; a missing part counts as empty text."""
    texts = [F.coalesce(part.cast("string"), F.lit("")) for part in parts]
    return F.substring(F.sha2(F.concat_ws(":", *texts), 256), 1, 32)


def minute_timestamp(text: Column) -> Column:
    """``yyyyMMddHHmm`` to a timestamp, null when it is anything else."""
    return F.when(
        text.rlike("^[0-9]{12}$"), F.try_to_timestamp(text, F.lit("yyyyMMddHHmm"))
    )


def iso_timestamp(text: Column) -> Column:
    """ISO 8601 date or time with ``Z`` or an offset, null when it is anything else."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(text))


def nonempty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def json_properties(properties: dict[str, Column]) -> Column:
    """JSON object of the properties that are neither null nor empty; null if none is."""
    fields = F.struct(*[nonempty(value).alias(name) for name, value in properties.items()])
    any_set = F.coalesce(*[nonempty(value) for value in properties.values()]).isNotNull()
    return F.when(any_set, F.to_json(fields))


def cursor_of(next_url: Column) -> Column:
    """The ``after`` parameter of a next-page link, null when there is none."""
    return F.url_decode(F.try_parse_url(next_url, F.lit("QUERY"), F.lit("after")))


def is_stablecoin(token: Column) -> Column:
    return F.coalesce(F.lower(token).isin(list(STABLECOINS)), F.lit(False))


def seconds(span: timedelta | float | int) -> float:
    return span.total_seconds() if isinstance(span, timedelta) else float(span)


def shift(timestamp: Column, by: timedelta | float | int) -> Column:
    """The timestamp moved by a span, to the microsecond."""
    return timestamp + F.make_dt_interval(secs=F.lit(f"{seconds(by):.6f}").cast("decimal(18,6)"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Difference in seconds as DOUBLE, to the microsecond."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000.0)


def power_of_ten(exponent: Column) -> Column:
    """10^exponent as DECIMAL(38,0), null outside 0..37."""
    table = F.array(*[F.lit(str(10**n)).cast("decimal(38,0)") for n in range(38)])
    return F.get(table, exponent.cast("int"))


def usd_value(raw: Column, token: Column, decimals: Column, price: Column) -> Column:
    """USD of a raw token amount as DECIMAL(38,6).

    A stablecoin counts one dollar per token whatever its price, and its
    decimals fall back to 6 when null or zero.  Any other token needs decimals
    and a price.  The amount is split at the decimal point first because a
    DECIMAL(38,0) quotient keeps six decimals only.
    """
    stable = is_stablecoin(token)
    places = F.when(stable, F.coalesce(F.nullif(decimals, F.lit(0)), F.lit(6))).otherwise(decimals)
    unit_price = F.when(stable, F.lit("1").cast("decimal(38,18)")).otherwise(
        price.cast("decimal(38,18)")
    )
    scale = power_of_ten(places)
    amount = raw.cast("decimal(38,0)")
    fraction = amount % scale
    whole = F.try_divide(amount - fraction, scale).cast("decimal(38,0)")
    whole_usd = F.try_multiply(whole, unit_price)
    fraction_usd = F.try_divide(F.try_multiply(fraction, unit_price), scale)
    return F.try_add(whole_usd, fraction_usd).try_cast("decimal(38,6)")


def month_of(timestamp: Column) -> Column:
    return F.trunc(timestamp.cast("date"), "month")

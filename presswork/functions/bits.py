"""Unsigned 64-bit fingerprints kept in signed longs, bit for bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOP, _ALL = "9223372036854775808", "18446744073709551616"


def _dec(text: str) -> Column:
    return F.lit(text).cast("decimal(20,0)")


def simhash_to_db(value: Column) -> Column:
    """An unsigned value (decimal) as the signed long with the same bits; out of range is an error."""
    v = value.cast("decimal(20,0)")
    bad = (v < _dec("0")) | (v >= _dec(_ALL))
    signed = F.when(v >= _dec(_TOP), v - _dec(_ALL)).otherwise(v)
    return F.when(bad, F.raise_error(F.concat(F.lit("not an unsigned 64-bit value: "), v.cast("string"))).cast("bigint")).otherwise(signed.cast("bigint"))


def simhash_from_db(value: Column) -> Column:
    """The unsigned value (decimal(20,0)) of a signed long."""
    v = value.cast("decimal(20,0)")
    return F.when(v < _dec("0"), v + _dec(_ALL)).otherwise(v).cast("decimal(20,0)")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))

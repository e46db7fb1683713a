"""Content hashes as expressions: FNV-1a, the 31-times text hash, chunk numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.vectors import col, let

#: Fixed values of FNV-1a with 32 bits.
FNV_START, FNV_PRIME, MASK = 2166136261, 16777619, 4294967295
CHUNKS = 64
#: Fixed value: units of a payload that its fingerprint reads.
MOST_UNITS = 1_000_000


def _codes(text: Column | str) -> Column:
    """The text's UTF-16 units: a character beyond U+FFFF is two."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(col(text), "UTF-16BE")), F.lit("(....)"), 1), lambda x: F.conv(x, 16, 10).cast("long"))


def _fnv(codes: Column) -> Column:
    step = lambda h, c: ((h.bitwiseXOR(c.cast("long"))) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(MASK).cast("long"))
    return F.aggregate(codes, F.lit(FNV_START).cast("long"), step)


def _base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


def fnv1a(text: Column | str) -> Column:
    """FNV-1a over the UTF-16 units, as an unsigned 32-bit number."""
    return _fnv(_codes(text))


def fnv_text(text: Column | str) -> Column:
    """The hash in base 36."""
    return _base36(fnv1a(text))


def fingerprint(text: Column | str) -> Column:
    """Length in UTF-16 units and hash, both in base 36; of more than MOST_UNITS units only every n-th is hashed, so that about as many are."""
    step = lambda codes: F.greatest(F.lit(1), F.ceil(F.size(codes) / MOST_UNITS))
    return let(_codes(text), lambda codes: F.concat_ws(".", _base36(F.size(codes)), _base36(_fnv(F.filter(codes, lambda c, i: i % step(codes) == 0)))))


def chunk_of(name: Column | str, chunks: int = CHUNKS) -> Column:
    """Two hex digits that deal names over ``chunks`` files."""
    return F.lpad(F.lower(F.hex(fnv1a(name) % chunks)), 2, "0")


def text_hash31(text: Column | str) -> Column:
    """h = 31 h + unit over the UTF-16 units, with 32-bit signed overflow."""
    wrap = lambda h: F.pmod(h + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return F.when(col(text) == "", F.lit(0).cast("long")).otherwise(F.aggregate(_codes(text), F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c)))

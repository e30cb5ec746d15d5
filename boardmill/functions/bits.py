"""Bit strings as arrays of 64-bit words: distances, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)


def word_count(df: DataFrame, words: str) -> int:
    """Words of a row, which all rows have as many of; 1 for an empty table."""
    return df.agg(F.max(F.size(words))).first()[0] or 1


def band(words: Column, start: int, end: int) -> list[Column]:
    """The bits from start to end, counted from the lowest of the first word, as numbers of up to 64 bits."""
    parts = []
    while start < end:
        word, low = divmod(start, WORD)
        size = min(WORD - low, end - start)
        part = F.get(words, F.lit(word))
        parts.append(part if size == WORD else F.shiftrightunsigned(part, low).bitwiseAND(F.lit((1 << size) - 1).cast("bigint")))
        start += size
    return parts


def band_hashes(words: Column, count: int, bands: int) -> Column:
    """An array of one hash for each of ``bands`` bands of the bits of ``count`` words.

    Rows that differ in fewer bits than there are bands share a hash (pigeonhole).
    """
    cuts = [WORD * count * k // bands for k in range(bands + 1)]
    return F.array(*[F.xxhash64(F.lit(k), *band(words, cuts[k], cuts[k + 1])) for k in range(bands)])

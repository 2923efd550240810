"""Column functions over DNA strings; all stay in the JVM except ``global_identity``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Base order of the packed form: A=0, C=1, T=2, G=3.
PACKED_ORDER = "ACTG"


def revcomp(seq: Column) -> Column:
    """Reverse complement; anything but A, C, G, T becomes N."""
    return F.translate(F.regexp_replace(F.reverse(seq), "[^ACGT]", "N"), "ACGT", "TGCA")


def revcomp_n_to_c(seq: Column) -> Column:
    """The variant whose fallback base is C, so that N becomes C as well."""
    return F.translate(F.regexp_replace(F.reverse(seq), "[^ACGT]", "N"), "ACGTN", "TGCAC")


def revcomp_keep(seq: Column) -> Column:
    """The variant that leaves other signs as they are."""
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def digits(seq: Column) -> Column:
    """The packed digits as a string, which sorts like the packed number."""
    return F.translate(seq, PACKED_ORDER, "0123")


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement, in packed order."""
    rc = revcomp(kmer)
    return F.when(digits(rc) < digits(kmer), rc).otherwise(kmer)


def canonical_text(kmer: Column) -> Column:
    """The smaller of both in alphabetical order."""
    return F.least(kmer, revcomp(kmer))


def pack(kmer: Column) -> Column:
    """Two bits a base as a long; for up to 31 bases of A, C, G, T."""
    return F.conv(digits(kmer), 4, 10).cast("long")


def unpack(value: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(value.cast("string"), 10, 4), k, "0"), "0123", PACKED_ORDER)


def revcomp_packed(value: Column, k: int) -> Column:
    """Reverse complement of a packed k-mer."""
    return pack(revcomp(unpack(value, k)))


def _pieces(k: int) -> list[tuple[int, int]]:
    """First letter (from 1) and length of the pieces of a k-mer, 31 letters and the rest."""
    return [(i + 1, min(31, k - i)) for i in range(0, k, 31)]


def pack_wide(kmer: Column, k: int) -> Column:
    """Two bits a base as longs, one for each 31 bases; arrays of one k sort like the k-mers."""
    return F.array(*[pack(F.substring(kmer, a, n)) for a, n in _pieces(k)])


def unpack_wide(value: Column, k: int) -> Column:
    return F.concat(*[unpack(F.get(value, F.lit(i)), n) for i, (_, n) in enumerate(_pieces(k))])


def revcomp_packed_wide(value: Column, k: int) -> Column:
    """Reverse complement of a packed k-mer of any length."""
    return pack_wide(revcomp(unpack_wide(value, k)), k)


def kmer_array(seq: Column, k: int) -> Column:
    """All substrings of k letters, in order; empty for shorter texts."""
    n = F.length(seq) - k + 1
    starts = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(seq, i, F.lit(k)))


def segments(seq: Column) -> Column:
    """The stretches between runs of N."""
    return F.filter(F.split(seq, "N+"), lambda s: s != "")


def has_no_n(kmer: Column) -> Column:
    return ~F.contains(kmer, F.lit("N"))


def prefix(seq: Column, k: int) -> Column:
    return F.left(seq, F.lit(k))


def suffix(seq: Column, k: int) -> Column:
    return F.right(seq, F.lit(k))


def last_base(seq: Column) -> Column:
    return F.right(seq, F.lit(1))


def column_slice(seq: Column, start: int, end: int) -> Column:
    """Columns start - 1 .. end of an alignment, counted from 0."""
    return F.substring(seq, F.lit(start), F.lit(end - start + 1))


def extend_canonical(kmer: Column, base: Column) -> tuple[Column, Column]:
    """(canonical k-mer, strand) after shifting in a base; strand 1 where the complement is smaller."""
    following = F.concat(F.substring(kmer, F.lit(2), F.length(kmer)), base)
    rc = revcomp(following)
    back = digits(rc) < digits(following)
    return F.when(back, rc).otherwise(following), F.when(back, F.lit(1)).otherwise(F.lit(0))


def largest_k(length: Column, ks: list[int]) -> Column:
    """The largest listed k that is no more than the length, else null."""
    out = F.lit(None).cast("int")
    for k in sorted(ks):
        out = F.when(length >= k, F.lit(k)).otherwise(out)
    return out


def stitch(seqs: Column, k: int) -> Column:
    """Join the sequences of a path whose neighbours overlap in k - 1 bases."""
    return F.concat(F.element_at(seqs, 1), F.array_join(F.transform(F.slice(seqs, F.lit(2), F.size(seqs)), lambda s: F.substring(s, F.lit(k), F.length(s))), ""))


def _identity(a: str, b: str, match: int = 10, mismatch: int = -5, gap: int = -5) -> float | None:
    """Of equal scores the diagonal goes first, then the gap in ``b``; cells of one antidiagonal are filled together."""
    if not a:
        return None
    n, m = len(a), len(b)
    x, y = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32), np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)[::-1]
    score, same = (np.zeros((3, n + 1), np.int64) for _ in range(2))  # by bases of a; the last three antidiagonals
    for d in range(1, n + m + 1):
        now, before, last = d % 3, (d - 1) % 3, (d - 2) % 3
        for edge in ([0] if d <= m else []) + ([d] if d <= n else []):
            score[now, edge], same[now, edge] = gap * d, 0
        lo, hi = max(1, d - m), min(n, d - 1)
        if lo > hi:
            continue
        equal = x[lo - 1 : hi] == y[m - d + lo : m - d + hi + 1]
        best, count = score[last, lo - 1 : hi] + np.where(equal, match, mismatch), same[last, lo - 1 : hi] + equal
        for at in (slice(lo - 1, hi), slice(lo, hi + 1)):
            other = score[before, at] + gap
            count = np.where(other > best, same[before, at], count)
            best = np.maximum(best, other)
        score[now, lo : hi + 1], same[now, lo : hi + 1] = best, count
    return int(same[(n + m) % 3, n]) / n


@F.pandas_udf(DoubleType())
def global_identity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Share of the first text's bases that a global alignment leaves identical."""
    for a, b in batches:
        yield pd.Series([None if x is None or y is None else _identity(x, y) for x, y in zip(a, b, strict=True)])

"""Row-local statistics of token arrays and number arrays: no explode, so no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline.functions.text import let


def run_lengths(ordered: Column) -> Column:
    """Counts of equal neighbours in a sorted array."""

    def edges(a: Column) -> Column:
        n = F.size(a)
        # the last place past the end compares with null and so is always an edge
        return F.when(n > 0, F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | F.coalesce(F.get(a, i) != F.get(a, i - 1), F.lit(True)))).otherwise(F.array().cast("array<int>"))

    def gaps(e: Column) -> Column:
        return F.transform(F.slice(e, 2, F.greatest(F.size(e), F.lit(1))), lambda x, i: x - F.get(e, i))

    return let(let(ordered, edges), gaps)


def total(a: Column, kind: str = "double") -> Column:
    return F.aggregate(a, F.lit(0).cast(kind), lambda s, x: s + x.cast(kind))


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def pop_std(a: Column, m: Column) -> Column:
    """Around a mean that is bound already."""
    return F.sqrt(F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)), F.size(a)))


def yule_k(counts: Column, n: Column) -> Column:
    pairs = F.aggregate(counts, F.lit(0).cast("long"), lambda s, c: s + c.cast("long") * (c - 1))
    return F.when(n > 1, 1e4 * pairs / (n.cast("double") * (n - 1))).otherwise(0.0)


def entropy(counts: Column, n: Column) -> Column:
    """Shannon entropy over its maximum; 0 for fewer than two kinds."""
    e = F.aggregate(counts, F.lit(0.0), lambda s, c: s - c / n * F.ln(c / n))
    return F.when(F.size(counts) > 1, e / F.ln(F.size(counts))).otherwise(0.0)


def rank_skew(counts: Column, n: Column) -> Column:
    """Share of the most frequent tenth of kinds, one kind at least."""
    top = F.slice(F.sort_array(counts, asc=False), 1, F.greatest(F.lit(1), F.floor(F.size(counts) / 10).cast("int")))
    return F.when(F.size(counts) > 1, total(top, "long") / n).otherwise(0.0)


def normal_sf(z: Column) -> Column:
    """Upper tail of the normal law by the Abramowitz-Stegun 26.2.17 polynomial; 1 and 1e-20 beyond -10 and 10."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = 0.3989422804014327 * F.exp(-x * x / 2) * poly
    return F.when(z > 10, 1e-20).when(z < -10, 1.0).when(z >= 0, tail).otherwise(1 - tail)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))

"""Pairs of 64-bit hashes within a Hamming distance."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import written

BITS = 64
#: A band's neighbourhood has at most so many values: they are literals of the plan.
MAX_PROBES = 1024


def distance(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def bands(most: int, n: int) -> list[tuple[int, int, int]]:
    """(first bit, width, radius) of n bands: hashes within ``most`` bits are within the radius in one.

    If every band differed by more than its radius, the whole would differ by at least the sum of
    radius + 1, which is most + 1.
    """
    cuts = [BITS * i // n for i in range(n + 1)]
    spare, extra = divmod(most + 1 - n, n)
    return [(cuts[i], cuts[i + 1] - cuts[i], spare + (i < extra)) for i in range(n)]


def probes(width: int, radius: int) -> int:
    """Values within a radius of one of ``width`` bits."""
    return sum(comb(width, r) for r in range(min(radius, width) + 1))


def expected_candidates(rows: int, found: list[tuple[int, int, int]]) -> float:
    """Pairs that the bands let through, for hashes with independent bits."""
    return sum(rows * rows * probes(w, r) / 2**w for _, w, r in found)


def best_bands(most: int, rows: int) -> list[tuple[int, int, int]]:
    """The bands with the least work, probes and candidates together, for so many distinct hashes.

    Few wide bands with a radius let through far fewer pairs than many narrow ones that must agree,
    but every hash then asks for a neighbourhood: worth it from some ten thousand hashes on.
    """
    found = [bands(most, n) for n in range(1, most + 2)]
    found = [b for b in found if all(probes(w, r) <= MAX_PROBES for _, w, r in b)]
    return min(found, key=lambda b: expected_candidates(rows, b) + rows * sum(probes(w, r) for _, w, r in b))


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << bit for bit in chosen) for r in range(min(radius, width) + 1) for chosen in combinations(range(width), r)]


def mask_array(width: int, radius: int) -> Column:
    """The masks of a neighbourhood as one constant: built by the parser, not by a call for each of them."""
    signed = (m - (1 << BITS) if m >> (BITS - 1) else m for m in _masks(width, radius))
    return F.expr("array(" + ", ".join(f"bigint('{m}')" if m == -(1 << (BITS - 1)) else f"{m}L" for m in signed) + ")")


def _bits(column: Column, low: int, width: int) -> Column:
    moved = F.shiftrightunsigned(column, low)
    return moved if width == BITS else moved.bitwiseAND(F.lit((1 << width) - 1))


def candidates(values: DataFrame, found: list[tuple[int, int, int]]) -> DataFrame:
    """(a, b, band) of distinct hashes that are within the radius in a band: one row for each such band."""
    def asked(i: int, low: int, width: int, radius: int) -> Column:
        mine = _bits(F.col("hash"), low, width)
        return F.transform(mask_array(width, radius), lambda m: F.struct(F.lit(i).alias("band"), mine.bitwiseXOR(m).alias("bits")))

    own = F.array(*[F.struct(F.lit(i).alias("band"), _bits(F.col("hash"), low, w).alias("bits")) for i, (low, w, _) in enumerate(found)])
    left = values.select(F.col("hash").alias("a"), F.explode(F.flatten(F.array(*[asked(i, *band) for i, band in enumerate(found)]))).alias("k")).select("a", "k.band", "k.bits")
    right = values.select(F.col("hash").alias("b"), F.explode(own).alias("k")).select("b", "k.band", "k.bits")
    return left.join(right, ["band", "bits"]).select("a", "b", "band")


def close_pairs(hashes: DataFrame, most: int, n_bands: int | None = None) -> DataFrame:
    """(a, b) with a < b of the distinct values of column ``hash`` that differ in at most ``most`` bits.

    The 64 bits are cut into bands with radii (``bands``): an equi-join of each hash's neighbourhood
    with the hashes, band by band, finds every pair; the whole distance decides. Values are made
    distinct first: many files with one hash are one row here. A pair is reported by the first band
    that finds it only, which spares a distinct over the pairs. The number of bands follows the number
    of hashes (``best_bands``) unless it is given; the pairs do not depend on it.
    """
    if most < 0:
        return hashes.select(F.col("hash").alias("a"), F.col("hash").alias("b")).limit(0)
    values = written(hashes.select(F.col("hash").cast("bigint").alias("hash")).filter(F.col("hash").isNotNull()).distinct(), "hashes")
    if most >= BITS:
        # Everything is close to everything: a star has the same components.
        return values.crossJoin(F.broadcast(values.agg(F.min("hash").alias("a")))).filter("hash != a").select("a", F.col("hash").alias("b"))
    found = best_bands(most, values.count()) if n_bands is None else bands(most, n_bands)
    inside = [distance(_bits(F.col("a"), low, w), _bits(F.col("b"), low, w)) <= r for low, w, r in found]
    first, missed = F.lit(False), F.lit(True)
    for i, near in enumerate(inside):
        first = first | ((F.col("band") == i) & missed)
        missed = missed & ~near
    joined = candidates(values, found).filter((F.col("a") < F.col("b")) & (distance(F.col("a"), F.col("b")) <= most))
    return joined.filter(first).select("a", "b")

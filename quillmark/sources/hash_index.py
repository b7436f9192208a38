"""A stored index of perceptual hashes: radius searches, and classes that grow with the hashes that arrive.

The 64 bits are cut into bands with radii (``plans.hamming.bands``), fixed when the index is made: two
hashes within ``most`` bits are within the radius in at least one band. For each band the index holds a
table (bits, hash), in a folder of its own. A search asks each band for the neighbourhoods of the given
hashes only, and the whole distance decides, so it is exact for any radius up to ``most``.

Versions only add: the new hashes' rows of the bands, their first roots, and which roots have since been
merged. An insertion compares new hashes with the stored ones and with each other, never two stored ones,
and joins classes by their roots.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.components import components, written
from ..plans.hamming import _bits, bands, best_bands, close_pairs, distance, mask_array
from .versions import Versioned


def distinct_hashes(hashes: DataFrame) -> DataFrame:
    """The distinct values of a column, as BIGINT column ``hash``; nulls are left out."""
    (name,) = hashes.columns
    return hashes.select(F.col(name).cast("bigint").alias("hash")).filter("hash IS NOT NULL").distinct()


def _reach(bits: Column, width: int, radius: int) -> Column:
    """All values of a band within a radius of its bits."""
    return F.transform(mask_array(width, radius), lambda m: bits.bitwiseXOR(m))


class HashIndex(Versioned):
    """The index in a folder; ``version`` is the one that is read."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        super().__init__(spark, root)
        found = self.versions()
        self.version = version if version is not None else found[-1] if found else 0
        self._state = self.entry(self.version) if self.version else {"most": 8, "bands": [], "parts": [], "merges": None}

    @property
    def most(self) -> int:
        return self._state["most"]

    @property
    def bands(self) -> list[tuple[int, int, int]]:
        return [tuple(b) for b in self._state["bands"]]

    @classmethod
    def create(cls, spark: SparkSession, root: str, hashes: DataFrame, most: int = 8, n_bands: int | None = None) -> HashIndex:
        """An index of the column's hashes for distances up to ``most``; bands follow their number unless given."""
        index = cls(spark, root)
        values = written(distinct_hashes(hashes), "index-hashes")
        found = best_bands(most, max(1, values.count())) if n_bands is None else bands(most, n_bands)
        index._state = {"most": most, "bands": [list(b) for b in found], "parts": [], "merges": None}
        return index.insert(values)

    def _read(self, kind: str, schema: str) -> DataFrame:
        parts = [f"{self.root}/{p}/{kind}" for p in self._state["parts"]]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def hashes(self) -> DataFrame:
        return self._read("roots", "hash long, root long").select("hash")

    def classes(self) -> DataFrame:
        """(hash, root): the smallest hash that small steps lead to, for every stored hash."""
        roots = self._read("roots", "hash long, root long")
        if not self._state["merges"]:
            return roots
        merges = self.spark.read.schema("node long, top long").parquet(f"{self.root}/{self._state['merges']}")
        return roots.join(merges, F.col("root") == F.col("node"), "left").select("hash", F.coalesce("top", "root").alias("root"))

    def within(self, hashes: DataFrame, most: int | None = None) -> DataFrame:
        """(query, hash, distance) of the stored hashes within a radius of each distinct given hash, itself included.

        Each pair comes once, from the first band that finds it. The bands' rows are read with their own
        filter on the band; given hashes are repeated for every value that their bands' radii reach.
        """
        most = self.most if most is None else most
        if most > self.most:
            raise ValueError(f"the index finds distances up to {self.most}")
        asked = distinct_hashes(hashes).withColumnRenamed("hash", "query")
        near = [distance(_bits(F.col("query"), low, w), _bits(F.col("hash"), low, w)) <= r for low, w, r in self.bands]
        found, missed = None, F.lit(True)
        for i, (low, width, radius) in enumerate(self.bands):
            own = _bits(F.col("query"), low, width)
            probes = asked.select("query", F.explode(_reach(own, width, radius)).alias("bits"))
            rows = self._read(f"bands/band={i}", "bits long, hash long")
            met = probes.join(rows, "bits").filter((distance(F.col("query"), F.col("hash")) <= most) & missed).select("query", "hash")
            found = met if found is None else found.unionByName(met)
            missed = missed & ~near[i]
        if found is None:
            return asked.select("query", F.col("query").alias("hash"), F.lit(0).alias("distance")).limit(0)
        return found.withColumn("distance", distance(F.col("query"), F.col("hash")))

    def insert(self, hashes: DataFrame) -> HashIndex:
        """The next version, with the column's hashes; those that are stored already change nothing."""
        new = written(distinct_hashes(hashes).join(self.hashes(), "hash", "left_anti"), "index-new")
        if new.isEmpty():
            self.publish(self.version + 1, self._state)
            return HashIndex(self.spark, self.root, self.version + 1)
        part = f"data/{uuid.uuid4().hex}"
        cut = F.array(*[F.struct(F.lit(i).alias("band"), _bits(F.col("hash"), low, w).alias("bits")) for i, (low, w, _) in enumerate(self.bands)])
        rows = new.select("hash", F.explode(cut).alias("b")).select("b.band", "b.bits", "hash")
        rows.repartitionByRange("band", "bits").sortWithinPartitions("band", "bits").write.partitionBy("band").parquet(f"{self.root}/{part}/bands")
        own = close_pairs(new, self.most)
        inside = components(own)
        named = new.join(inside.withColumnRenamed("node", "hash"), "hash", "left").select("hash", F.coalesce("root", "hash").alias("root"))
        named.write.parquet(f"{self.root}/{part}/roots")
        # A new hash that is near a stored one ties its own class to the stored one's.
        merges = self._state["merges"]
        if self._state["parts"]:
            fresh = self.spark.read.schema("hash long, root long").parquet(f"{self.root}/{part}/roots")
            met = self.within(new).select("query", F.col("hash").alias("near"))
            ties = met.join(fresh.select(F.col("hash").alias("query"), F.col("root").alias("a")), "query").join(self.classes().select(F.col("hash").alias("near"), F.col("root").alias("b")), "near").select("a", "b").distinct()
            if merges:
                ties = ties.unionByName(self.spark.read.schema("node long, top long").parquet(f"{self.root}/{merges}").select(F.col("node").alias("a"), F.col("top").alias("b")))
            merges = f"{part}/merges"
            components(ties).select("node", F.col("root").alias("top")).write.parquet(f"{self.root}/{merges}")
        parts = [*self._state["parts"], part]
        self.publish(self.version + 1, self._state | {"parts": parts, "merges": merges})
        return HashIndex(self.spark, self.root, self.version + 1)

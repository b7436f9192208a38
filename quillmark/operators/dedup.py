"""Clusters of exact and near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import components, written
from ..plans.hamming import close_pairs
from ..plans.ranking import ranked
from ..sources.catalog import Catalog
from .collections import durable_paths
from .query import Query, filtered


def scope(catalog: Catalog, under: str | None) -> DataFrame:
    """Scoping comes before clustering: members elsewhere do not count."""
    return filtered(catalog, Query(under=under))


def clusters(labelled: DataFrame) -> DataFrame:
    """Ordered clusters of rows with a label.

    Sandbox views of a content that has another file go first; then singletons. cluster_id is the
    keeper's path, rank the place in the cluster (size descending, path), members the count.
    """
    kept = durable_paths(labelled)
    # Members are counted with partial sums and placed by sorted ranges of the whole order: a cluster
    # that holds most of a library loads no single task.
    counted = kept.groupBy("label").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    placed = ranked(kept.join(counted, "label"), F.col("label"), F.desc("size"), F.col("path"), name="_place")
    first = placed.groupBy("label").agg(F.min(F.struct("_place", "path")).alias("first"))
    rank = F.col("_place") - F.col("first._place") + 1
    return placed.join(first, "label").select(F.col("first.path").alias("cluster_id"), rank.alias("rank"), "members", "path", "content_hash", "size")


def exact_duplicates(catalog: Catalog, under: str | None = None) -> DataFrame:
    rows = scope(catalog, under).select("path", "content_hash", "size", F.col("content_hash").alias("label"))
    return clusters(rows)


def near_pairs(catalog: Catalog, most: int = 8, under: str | None = None) -> DataFrame:
    """Pairs of different perceptual hashes within the distance."""
    return close_pairs(scope(catalog, under).select(F.col("phash").alias("hash")), most)


def near_duplicates(catalog: Catalog, most: int = 8, under: str | None = None) -> DataFrame:
    """Transitive clusters of files of one content or of close perceptual hashes.

    Nodes are contents and distinct hashes, not files: a file links its content to its hash, and two
    hashes within the distance are linked. Groups of equal files or hashes are single nodes, however
    many files they have.
    """
    rows = written(scope(catalog, under).select("path", "content_hash", "size", "phash"), "near-scope")
    hashed = rows.filter("phash IS NOT NULL")
    node = lambda c: F.concat(F.lit("p:"), F.col(c).cast("string"))
    content = F.concat(F.lit("c:"), F.col("content_hash"))
    own = hashed.select(content.alias("a"), node("phash").alias("b")).distinct()
    close = close_pairs(hashed.select(F.col("phash").alias("hash")), most).select(node("a").alias("a"), node("b").alias("b"))
    roots = components(own.unionByName(close))
    labelled = rows.withColumn("node", content).join(roots, "node", "left").select("path", "content_hash", "size", F.coalesce("root", "node").alias("label"))
    return clusters(labelled)


def reclaimable(found: DataFrame) -> DataFrame:
    """Bytes of all members but the keepers."""
    return found.agg(F.coalesce(F.sum(F.when(F.col("rank") > 1, F.greatest("size", F.lit(0)))), F.lit(0)).alias("bytes"), F.count(F.when(F.col("rank") == 1, 1)).alias("clusters"))


def shown_clusters(found: DataFrame, most: int = 200, members: int = 12) -> DataFrame:
    """The largest clusters with their first members and how many more there are.

    Clusters come by number of members, then by keeper's path. Only the first members are gathered.
    """
    first = found.filter(F.col("rank") <= members).groupBy("cluster_id", F.col("members").alias("n")).agg(F.sort_array(F.collect_list(F.struct("rank", "path"))).alias("firsts"))
    return first.select("cluster_id", F.col("n").alias("members"), F.transform("firsts", lambda x: x["path"]).alias("paths"), F.greatest(F.col("n") - members, F.lit(0)).alias("more")).orderBy(F.desc("members"), "cluster_id").limit(most)

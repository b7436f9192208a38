"""Connected components of an edge table, as a loop of joins and grouped minima."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of intermediate tables that this process has written.
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the cluster's setting, or one made for a local session."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='quillmark-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df, written to the session's shared checkpoint folder and read again: short lineage, no recomputation.

    Filters on the columns ``by`` then read only their own folders.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillmark/{uuid.uuid4().hex}-{name}"
    _written.append(path)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_so_far() -> int:
    """How many intermediate tables this process keeps: a mark for clear_written."""
    return len(_written)


def clear_written(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the intermediate tables that were written since a mark, but for the last ``keep``.

    Only once no result that reads them is needed; without a mark, all of this process.
    """
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    end = len(_written) - keep
    gone = 0
    for name in _written[since:end]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        gone += bool(path.getFileSystem(conf).delete(path, True))
    del _written[since:end]
    return gone


def _finished(links: DataFrame) -> bool:
    """Whether every node links to one node only, and that node to none: components are stars."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("met")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("met")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("met").alias("met")).filter("out > 1 OR (out = 1 AND met = 1)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges; root is the smallest node of its component.

    Each round replaces the edges by smaller ones with the same components: every node is linked to
    the smallest node it knows (large-star), then every node hands its smaller neighbours to the
    smallest of them (small-star). Edges never multiply, the rounds are about log2 of the longest
    path, and the loop ends when all components are stars. Minima are grouped with partial counts,
    so a node with very many links loads no single task.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    links = written(links, "links")
    while not _finished(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # Large-star: larger neighbours of u go to the smallest node that u knows.
        large = links.select(F.col("v").alias("u"), F.col("u").alias("v")).join(written(least, "least"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u != v").distinct(), "large-star")
        # Small-star: u and its smaller neighbours go to the smallest of these.
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links = written(small.filter("u != v").distinct(), "small-star")
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())

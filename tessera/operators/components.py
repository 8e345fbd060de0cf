"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one only for a local master where unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Written tables in the shared folder: they cut lineage and survive lost executors. What is not dropped goes with
    the application."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path = self._path("")
        self._files(path).deleteOnExit(path)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _files(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self._path(name)
            self._files(path).delete(path, True)


def thinned(edges: DataFrame, src: str = "src", dst: str = "dst", nodes: int = 1 << 18) -> DataFrame:
    """Edges that connect just what ``edges`` do: each task gives each node but the least of a part, with the least one.

    A task holds the parts of about ``nodes`` nodes and then begins anew, which gives more edges, never fewer. Null
    ends are ignored.
    """
    plain = edges.select(src, dst)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        kinds = None

        def top(node):
            while (above := parent.setdefault(node, node)) != node:
                parent[node] = node = parent[above]
            return node

        def stars() -> pa.RecordBatch:
            found = [(node, least) for node in list(parent) if (least := top(node)) != node]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], kinds[n].type) for n in (0, 1)], [src, dst])

        for batch in batches:
            kinds = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if a is not None and b is not None:
                    a, b = top(a), top(b)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
            if len(parent) > nodes:
                yield stars()
        if parent:
            yield stars()

    return plain.mapInArrow(run, plain.schema)


def linked_components(links: DataFrame, few: int = 1 << 17) -> DataFrame:
    """``connected_components`` of many links (src, dst) of one type between few nodes: tasks thin them out first, and
    if at most ``few`` are left, one more task ends it."""
    scratch = Scratch(links.sparkSession, "links")
    stars = scratch.table(thinned(links), "stars")
    if stars.count() > few:  # from the files' footers
        return connected_components(stars)
    ends = thinned(stars.repartition(1), nodes=2 * few).select(F.col("src").alias("node"), F.col("dst").alias("component"))
    own = ends.select(F.col("component").alias("node"), "component").distinct()
    return scratch.table(ends.unionByName(own), "components")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach.

    Each round takes the least label of a node's neighbours and then the label of its label, so the number of rounds is
    logarithmic in the length of paths; each is a written table, the lineage stays short. Null ends are ignored. A hub, or
    the label of a giant component, may be the key of most rows of a join; both sides are shuffled tables with one row a
    key on one side, so adaptive execution splits such a key over tasks.
    """
    scratch = Scratch(edges.sparkSession, "components")
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    both = scratch.table(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    labels = labels.select("node", F.least("node", "low").alias("component"))
    labels = scratch.table(labels, "labels-0")
    step = 0
    while True:
        step += 1
        near = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy(F.col("a").alias("near_node"))
            .agg(F.min("component").alias("near"))
        )
        hooked = labels.join(near, F.col("node") == F.col("near_node")).select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("component")
        )
        top = labels.select(F.col("node").alias("top_node"), F.col("component").alias("top"))
        jumped = hooked.join(top, F.col("component") == F.col("top_node")).select(
            "node", "was", F.least("component", "top").alias("component")
        )
        fresh = scratch.table(jumped, f"labels-{step}")
        changed = not fresh.filter("component <> was").isEmpty()
        scratch.drop(f"labels-{step - 1}")
        labels = fresh.select("node", "component")
        if not changed:
            scratch.drop("edges")
            return labels

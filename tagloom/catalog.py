"""The tables of one tag graph, side by side."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom import schema
from tagloom.util import saved

#: Edges in one file of a written graph.
ROWS_PER_FILE = 5_000_000


@dataclass
class TagCatalog:
    """Files, tags and the edges between them; ``rel`` is kept in one folder per namespace, so reads by namespace skip the rest."""

    namespace: DataFrame
    tags: DataFrame
    rel: DataFrame
    parents: DataFrame
    files: DataFrame
    file_hashes: DataFrame
    jobs: DataFrame
    dead_urls: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> TagCatalog:
        return TagCatalog(**{f.name: spark.createDataFrame([], getattr(schema, f.name.upper())) for f in fields(TagCatalog)})

    @staticmethod
    def from_parquet(spark: SparkSession, root: str) -> TagCatalog:
        return TagCatalog(**{f.name: spark.read.schema(getattr(schema, f.name.upper())).parquet(f"{root}/{f.name}") for f in fields(TagCatalog)})

    def write(self, root: str) -> None:
        """A snapshot under ``root``.

        Edges are gathered by namespace, so a namespace has few files, and lie in the order of their tags there, so a search
        skips the row groups without its tags.
        """
        self.write_edges(root)
        for f in fields(self):
            if f.name != "rel":
                getattr(self, f.name).write.mode("overwrite").parquet(f"{root}/{f.name}")

    def write_edges(self, root: str, name: str | None = None, buckets: int | None = None) -> DataFrame:
        """Write the edges alone, and return them as they lie there.

        A file holds about ROWS_PER_FILE edges: with more of them there are more files, and more tasks that write them. With a
        ``name`` they become a table in ``buckets`` (by the same measure, unless given) by file: a search then groups its
        edges by file without a shuffle.
        """
        spark = self.rel.sparkSession
        # Written once to be counted, as edges may come from joins that cost more than a copy.
        rel = saved(self.rel.select("file_id", "tag_id", "namespace"))
        n = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rel.count() // ROWS_PER_FILE))
        if name is None:
            part = F.pmod(F.xxhash64("file_id"), F.lit(n))
            edges = rel.repartition(n, "namespace", part).sortWithinPartitions("namespace", "tag_id", "file_id")
            edges.write.mode("overwrite").partitionBy("namespace").parquet(f"{root}/rel")
            return spark.read.schema(schema.REL).parquet(f"{root}/rel")
        writer = rel.repartition(n, "file_id").write.mode("overwrite").format("parquet").option("path", f"{root}/rel")
        writer.partitionBy("namespace").bucketBy(n, "file_id").sortBy("tag_id").saveAsTable(name)
        return spark.table(name).select("file_id", "tag_id", "namespace")

    def replace_namespaces(self, root: str, edges: DataFrame, namespaces: DataFrame) -> None:
        """Write the edges of some namespaces (namespace) under ``root`` anew; the folders of all others stay as they are.

        ``edges`` may be read from there: it is written beside first.
        """
        kept = saved(edges.join(F.broadcast(namespaces.select("namespace").distinct()), "namespace", "left_semi").select("file_id", "tag_id", "namespace"))
        n = max(1, -(-kept.count() // ROWS_PER_FILE))
        ordered = kept.repartition(n, "namespace", F.pmod(F.xxhash64("file_id"), F.lit(n))).sortWithinPartitions("namespace", "tag_id", "file_id")
        ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace").parquet(f"{root}/rel")

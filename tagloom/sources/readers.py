"""Where tables come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def existing_columns(df: DataFrame, schema: str) -> DataFrame:
    """``df`` in the shape of ``schema``: columns it lacks are null, others are left out."""
    from pyspark.sql.types import StructType

    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema).fields])


def tables(spark: SparkSession, root: str, schema_by_name: dict[str, str]) -> dict[str, DataFrame]:
    """Parquet folders below ``root``, each in its schema; one that doesn't exist is empty."""
    from pyspark.errors import AnalysisException

    out = {}
    for name, ddl in schema_by_name.items():
        try:
            out[name] = existing_columns(spark.read.parquet(f"{root}/{name}"), ddl)
        except AnalysisException:
            out[name] = spark.createDataFrame([], ddl)
    return out


def jdbc(spark: SparkSession, url: str, name: str, key: str, lower: int, upper: int, parts: int) -> DataFrame:
    """A database's table, read in ranges of ``key`` at once."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=parts).load()


def sqlite(spark: SparkSession, path: str, name: str, schema: str, parts: int = 8) -> DataFrame:
    """A table of an SQLite file, in the shape of ``schema``, read in ranges of its row numbers at once.

    Columns that it lacks are null, a table that it lacks is empty; the file is opened for reading only, and lies where all
    executors see it.
    """
    import sqlite3
    from contextlib import closing

    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(schema)
    opened = lambda: closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True))
    quoted = lambda x: '"' + x.replace('"', '""') + '"'
    with opened() as db:
        have = {r[1] for r in db.execute(f"pragma table_info({quoted(name)})")}
        low, high = db.execute(f"select min(rowid), max(rowid) from {quoted(name)}").fetchone() if have else (None, None)
    if low is None:
        return spark.createDataFrame([], wanted)
    cols = ", ".join(quoted(f.name) if f.name in have else "null" for f in wanted.fields)
    step = -(-(high - low + 1) // parts)

    def read(batches):
        import pandas as pd

        with opened() as db:
            for b in batches:
                for k in b["id"].tolist():
                    rows = db.execute(f"select {cols} from {quoted(name)} where rowid >= ? and rowid < ?", (low + k * step, low + (k + 1) * step))
                    while part := rows.fetchmany(50_000):
                        yield pd.DataFrame(part, columns=wanted.names, dtype="object")

    return spark.range(0, parts, 1, parts).mapInPandas(read, wanted)


def file_tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of all files below ``root``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length", "content")


def with_sidecars(tree: DataFrame) -> DataFrame:
    """Files beside the text and JSON files that are named after them: (path, length, text, json)."""
    parts = tree.withColumn("owner", F.regexp_replace("path", r"\.(txt|json)$", "")).withColumn("kind", F.regexp_extract("path", r"\.(txt|json)$", 1))
    side = parts.filter("kind <> ''").join(tree.select(F.col("path").alias("owner")), "owner", "left_semi").select("path", "owner", "kind", F.decode("content", "UTF-8").alias("body"))
    body = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("body"))).alias("text" if kind == "txt" else kind)
    wide = side.groupBy(F.col("owner").alias("path")).agg(body("txt"), body("json"))
    return tree.select("path", "length").join(side.select("path"), "path", "left_anti").join(wide, "path", "left")

"""Queues of jobs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Sites whose jobs the engine itself does, and how other names of such sites begin.
SYSTEM_SITES = ("SYSTEM_DATABASE_BACKUP", "SYSTEM_DATABASE_SLURP", "SYSTEM_FILE_SIZE", "SYSTEM_FILE_HASH")
SYSTEM_PREFIX = "SYSTEM_"
_RECREATION = "kind string, interval long, count long"


def runnable(jobs: DataFrame, now: int, per_site: int) -> DataFrame:
    """Per site the ``per_site`` due jobs that go first: by priority, then the earlier time, then the smaller id.

    Spark keeps only the first rows of each site in every task before they are gathered, so a site may hold any share of jobs.
    """
    due = jobs.filter(~F.col("is_running") & (F.col("time") + F.col("reptime") <= now))
    rank = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("priority"), "time", "id"))
    return due.withColumn("rank", rank).filter(F.col("rank") <= per_site)


def upsert(jobs: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """``jobs`` with ``new`` rows: one row per (time, reptime, site, param), with the priority and user data of the last by ``order``.

    A job that exists keeps its id and everything else; new ids follow the greatest one.
    """
    from tagloom.operators.ids import dense_ids

    key = ["time", "reptime", "site", "param"]
    last = new.groupBy(*key).agg(F.max_by(F.struct("priority", "user_data", "recreation"), order).alias("_n"))
    kept = jobs.join(last, key, "left").withColumn("priority", F.when(F.col("_n").isNotNull(), F.col("_n.priority")).otherwise(F.col("priority"))).withColumn("user_data", F.when(F.col("_n").isNotNull(), F.col("_n.user_data")).otherwise(F.col("user_data"))).select(jobs.columns)
    top = jobs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = dense_ids(last.join(jobs, key, "left_anti").select(*key, "_n.*"), key, start=top + 1)
    return kept.unionByName(added.withColumn("is_running", F.lit(False)).select(jobs.columns))


def recreated(jobs: DataFrame, now: int) -> DataFrame:
    """What finished jobs come back as: those that repeat, with one repetition less where they are counted."""
    r = F.from_json("recreation", _RECREATION)
    rows = jobs.withColumn("_r", r).filter("_r.kind = 'AlwaysTime' and (_r.count is null or _r.count >= 1)")
    return rows.select("id", F.lit(now).cast("long").alias("time"), F.col("_r.interval").alias("reptime"), F.lit(False).alias("is_running"), (F.col("_r.count") - 1).alias("count"), "site", "param")


def retry_later(jobs: DataFrame, ids: list[int], now: int, seconds: int) -> DataFrame:
    hit = F.col("id").isin(ids)
    return jobs.withColumns({"time": F.when(hit, F.lit(now).cast("long")).otherwise(F.col("time")), "reptime": F.when(hit, F.lit(seconds).cast("long")).otherwise(F.col("reptime")), "is_running": F.col("is_running") & ~hit})


def without(jobs: DataFrame, ids: list[int]) -> DataFrame:
    return jobs.filter(~F.col("id").isin(ids))


def grouped_by_plugin(jobs: DataFrame, routes: DataFrame) -> DataFrame:
    """(plugin, n_jobs, first_job) of jobs routed by site; ``routes`` has (site, plugin)."""
    return jobs.join(routes, "site").groupBy("plugin").agg(F.count(F.lit(1)).alias("n_jobs"), F.min("id").alias("first_job"))


def of_site(jobs: DataFrame, site: str) -> DataFrame:
    return jobs.filter(F.col("site") == site)


def sites(jobs: DataFrame) -> DataFrame:
    """(site), each once; jobs without one have none."""
    return jobs.filter("site is not null").select("site").distinct()


def param_field(jobs: DataFrame, field: str, kind: str = "long") -> DataFrame:
    """(id, ``field``) out of the JSON of each job's parameter; null where it isn't there or can't be read."""
    return jobs.select("id", F.from_json("param", f"{field} {kind}")[field].alias(field))


def is_system(jobs: DataFrame) -> DataFrame:
    """(id, system): is it one of the engine's own jobs, by its site, or a repeating one whose site is named like them?"""
    repeats = F.from_json("recreation", _RECREATION)["kind"] == "AlwaysTime"
    named = F.col("site").isin(*SYSTEM_SITES) | (F.col("site").startswith(SYSTEM_PREFIX) & F.coalesce(repeats, F.lit(False)))
    return jobs.select("id", F.coalesce(named, F.lit(False)).alias("system"))


def completed(jobs: DataFrame, done: DataFrame, now: int) -> DataFrame:
    """``jobs`` after those in ``done`` (id) are done: the repeating ones wait for their next time, the others are gone.

    A repetition that is counted is one fewer afterwards; at none left the job goes.
    """
    hit = jobs.join(done.select("id").distinct().withColumn("_done", F.lit(True)), "id", "left").withColumn("_r", F.from_json("recreation", _RECREATION))
    again = F.coalesce((F.col("_r.kind") == "AlwaysTime") & (F.col("_r.count").isNull() | (F.col("_r.count") >= 1)), F.lit(False))
    over = F.col("_done").isNotNull()
    next_one = F.to_json(F.struct(F.col("_r.kind").alias("kind"), F.col("_r.interval").alias("interval"), (F.col("_r.count") - 1).alias("count")))
    changed = {
        "time": F.when(over, F.lit(now).cast("long")).otherwise(F.col("time")), "reptime": F.when(over, F.col("_r.interval")).otherwise(F.col("reptime")),
        "is_running": F.col("is_running") & ~over, "recreation": F.when(over, next_one).otherwise(F.col("recreation")),
    }
    return hit.filter(~over | again).withColumns(changed).select(jobs.columns)


def running(jobs: DataFrame, ids: list[int]) -> DataFrame:
    """``jobs`` with these set running."""
    return jobs.withColumn("is_running", F.col("is_running") | F.col("id").isin(ids))


def reset(jobs: DataFrame) -> DataFrame:
    """``jobs`` with none running, as after a restart."""
    return jobs.withColumn("is_running", F.lit(False))


def without_known_tag(jobs: DataFrame, number: str, rel: DataFrame) -> DataFrame:
    """Jobs (id) but those whose parameter's ``number`` is a tag that some file has."""
    known = rel.select(F.col("tag_id").alias("_k")).distinct()
    return param_field(jobs, number).join(known, F.col(number) == F.col("_k"), "left_anti").select("id")

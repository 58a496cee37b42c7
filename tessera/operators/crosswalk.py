"""Who is whom, in versions: a crosswalk that only grows, kept up by what a delivery changes.

Three tables below one folder: ``labels`` (id, person_key) and ``links`` (a, b, live), both by version, and ``commits``. A version holds the rows that it changes and no others; a reader
takes the last committed word on each id. A delivery looks at new links and at the people they touch: new links join labels, which are few beside people, and
a withdrawn link has only its own group taken apart, from the links that survive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.plans.scratch import written

LABELS, LINKS = "id long, person_key long, version long", "a long, b long, live boolean, version long"


def _committed(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    """Versions that are complete, up to ``version``: one marker a delivery."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    found = sorted(int(f.getPath().getName()) for f in files.listStatus(where) if f.getPath().getName().isdigit())
    return [v for v in found if version is None or v <= version]


def _table(spark: SparkSession, path: str, name: str, schema: str, version: int | None) -> DataFrame:
    done = _committed(spark, path, version)
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{name}/{v}" for v in done])


def labels(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``(id, person_key)`` as of a version, the last one if none is given: the assignment that was in force then."""
    return _table(spark, path, "labels", LABELS, version).groupBy("id").agg(F.max_by("person_key", "version").alias("person_key"))


def links(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``(a, b)`` with a < b: links given and not withdrawn as of a version."""
    last = _table(spark, path, "links", LINKS, version).groupBy("a", "b").agg(F.max_by("live", "version").alias("live"))
    return last.where("live").select("a", "b")


def deliver(spark: SparkSession, path: str, ids: DataFrame, added: DataFrame, withdrawn: DataFrame | None = None) -> int:
    """Add a version: people ``ids`` (id), links ``added`` and ``withdrawn`` (a, b). Returns how many people's keys were written.

    Keys are the smallest ids of the groups that all surviving links make, whatever the order of deliveries. People seen before, links given
    before and links withdrawn that never were change nothing; a link both added and withdrawn in a delivery is withdrawn; ids of links count as people. Nulls are ignored. What a delivery wrote
    before it failed is never read, and is overwritten by the next.
    """
    done = _committed(spark, path)
    version = done[-1] + 1 if done else 1
    plain = lambda t: t.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    gone = plain(withdrawn) if withdrawn is not None else spark.createDataFrame([], "a long, b long")
    was = links(spark, path)
    gone = written(gone.join(was, ["a", "b"], "left_semi"), "withdrawn")
    fresh = plain(added)
    if withdrawn is not None:
        fresh = fresh.join(plain(withdrawn), ["a", "b"], "left_anti")
    fresh = written(fresh.join(was, ["a", "b"], "left_anti"), "added")
    before = labels(spark, path)
    # People that are new stand alone at first.
    named = ids.select("id").union(fresh.select(F.explode(F.array("a", "b")).alias("id"))).where("id is not null").distinct()
    new = written(named.join(before, "id", "left_anti").select("id", F.col("id").alias("person_key")), "new")
    # Groups that lose a link are made anew from the links that are left to them.
    torn = gone.join(before, gone.a == before.id).select("person_key").distinct()
    members = written(before.join(torn, "person_key", "left_semi").select("id", "person_key"), "torn")
    rest = was.join(gone, ["a", "b"], "left_anti").join(members.select(F.col("id").alias("a")), "a", "left_semi")
    parts = connected_components(rest).toDF("id", "part")
    apart = written(members.join(parts, "id", "left").select("id", F.coalesce("part", "id").alias("person_key")), "parts")
    # Labels now, before new links join them.
    now = before.join(apart.select("id"), "id", "left_anti").unionByName(apart).unionByName(new)
    left, right = now.toDF("a", "x"), now.toDF("b", "y")
    joins = written(fresh.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")), "joins")
    merged = connected_components(joins).toDF("person_key", "into").where("person_key <> into")
    moved = now.join(merged, "person_key").select("id", F.col("into").alias("person_key"))
    moved = written(moved, "moved")
    stayed = apart.unionByName(new).join(moved.select("id"), "id", "left_anti")
    changed = moved.unionByName(stayed).join(before.withColumnRenamed("person_key", "old"), "id", "left").where("old is null or old <> person_key")
    changed.select("id", "person_key", F.lit(version).cast("long").alias("version")).write.mode("overwrite").parquet(f"{path}/labels/{version}")
    told = fresh.withColumn("live", F.lit(True)).unionByName(gone.withColumn("live", F.lit(False)))
    told.select("a", "b", "live", F.lit(version).cast("long").alias("version")).write.mode("overwrite").parquet(f"{path}/links/{version}")
    n = spark.read.schema(LABELS).parquet(f"{path}/labels/{version}").count()
    # The marker is made last, and only once: a second writer of the same version is told.
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits/{version}")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).createNewFile(where):
        raise RuntimeError(f"version {version} was committed by another writer")
    return n

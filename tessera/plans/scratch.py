"""Tables written in the folder that every executor shares.

Long or iterative plans cut their lineage here: what is written survives a lost
executor, and a reader never recomputes the stages before it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; on a local master without one, a temporary folder of this process.

    Raises ValueError on a cluster that names no folder: a driver-local one would be invisible to the executors.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="spark-tessera-")
    return _LOCAL[sc.applicationId]


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, written now and read from there from now on."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables made by ``written`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_tessera_path", None)
        if path:
            jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)

"""Tables between the steps of an operator.

A step whose rows are needed more than once is written as Parquet under
``spark.checkpoint.dir``, the folder that the cluster shares, and read again.
That cuts lineage: a lost executor costs only the tasks that it ran.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, else a folder of the warehouse. A temporary one only on a local master."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.braid.scratch", None)
    if not at:
        if spark.sparkContext.master.startswith("local"):
            at = "file://" + tempfile.mkdtemp(prefix="braid-")
        else:
            at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_braid"
        spark.conf.set("spark.braid.scratch", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    at = f"{shared_dir(spark)}/braid/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once, from a table in the shared folder."""
    spark = df.sparkSession
    at = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for at in paths:
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete every table that this application wrote. Results that still read them fail afterwards."""
    _delete(spark, _written.pop(spark.sparkContext.applicationId, []))


def finished(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` gives, written; the tables that were written on the way are deleted."""
    own = _written.setdefault(spark.sparkContext.applicationId, [])
    before = len(own)
    out = written(make(), name)
    _delete(spark, own[before:-1])
    del own[before:-1]
    return out


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names near ``wanted`` that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out

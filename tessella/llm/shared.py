"""What the operators of this package share: the shared scratch folder, staged tables and the learning split."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: Paths staged by this driver and not yet deleted.
_STAGED: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that the cluster names in spark.checkpoint.dir.

    Only a local master without that setting (tests) gets a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="tessella-"))
    return f"{base.rstrip('/')}/tessella/{os.getpid()}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: short lineage that survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    _STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _deleted(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cleared(spark: SparkSession) -> None:
    """Delete all that this driver has staged, once the results built on it are written."""
    _deleted(spark, scratch(spark, "any").rsplit("/", 1)[0])
    _STAGED.clear()


def staged_so_far() -> int:
    """How many tables are staged, for ``released``."""
    return len(_STAGED)


def released(spark: SparkSession, since: int, kept: DataFrame) -> None:
    """Delete what was staged after the first ``since`` tables, but for ``kept``, a staged table that needs none of it."""
    own = {f.rsplit("/", 1)[0].split("/", 1)[1].lstrip("/") for f in kept.inputFiles()}
    for path in _STAGED[since:]:
        if path.split("/", 1)[1].lstrip("/") not in own:
            _deleted(spark, path)
            _STAGED.remove(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a staged table that no plan reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _deleted(spark, path)


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished stages: it does once the driver's garbage is collected."""
    for _ in range(2):  # what this process lets go of first, the driver's JVM can collect then
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; such rows teach no classifier. Null ids: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def share_by_hash(key: str, seed: int, share: Column | float) -> Column:
    """Keeps about ``share`` of the rows, the same ones on every run and at every partitioning."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < share * F.lit(1_000_000.0)


#: A group with more than a HUBS-th of all grouped rows is a hub, so there are fewer than HUBS of them.
HUBS = 500


def with_groups(rows: DataFrame, groups: DataFrame, key: str, spread: Column, outer: bool = False) -> DataFrame:
    """``rows`` that have a group (``outer``: all rows), with its columns, in one pass over rows; no key fills a task.

    ``groups``: (key, n, more columns), staged, n the rows of a group. Hubs are broadcast, and their rows are dealt by
    ``spread``, of the key's type, in the shuffle that joins all others.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0
    hub = F.col("n") * HUBS > F.lit(total)
    more = F.struct(*(c for c in groups.columns if c not in (key, "n")))
    hubs = groups.filter(hub).select(key, more.alias("_hub"))
    rest = groups.filter(~hub).select(F.col(key).alias("_k"), more.alias("_rest"))
    met = rows.join(F.broadcast(hubs), key, "left").withColumn("_own", F.when(F.col("_hub").isNull(), F.col(key)).otherwise(spread))
    met = met.join(rest, (F.col("_own") == F.col("_k")) & F.col("_hub").isNull(), "left")
    met = met.withColumn("_got", F.coalesce("_hub", "_rest"))
    return (met if outer else met.filter("_got is not null")).select(*rows.columns, "_got.*")

"""Cutting lineage in a way that survives lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables written by this process, by session: see ``clean``.
_written: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="factloom-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """A copy as a table in the shared folder.

    A table starts a new plan: unlike the rows of ``DataFrame.checkpoint`` it does not carry the constraints that
    the optimizer inferred so far, which in loops grow beyond measure, and later stages read only the columns
    that they use.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def by_product(df: DataFrame) -> DataFrame:
    """A copy as ``checkpoint`` makes it, dealt into buckets by ``product_id``.

    Steps that group or join such tables by the product and more need no shuffle (see ``together``): rows cross the
    network once, when they are written.  Shuffles that led here are removed.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"cut_{uuid.uuid4().hex}"
    path = f"{folder(spark)}/{name}"
    df.repartition(n, "product_id").write.bucketBy(n, "product_id").option("path", path).format("parquet").saveAsTable(name)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    sweep(spark)
    return spark.table(name)


def drop(df: DataFrame) -> None:
    """Removes the files of a table of ``by_product`` that nothing will read again."""
    spark = df.sparkSession
    ours = _written.get(spark.sparkContext.applicationId, [])
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for mine in [p for p in ours if path.rsplit("/", 1)[-1] == p.rsplit("/", 1)[-1]]:
            _remove(spark, mine)
            ours.remove(mine)


def sweep(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of frames that nothing refers to any more."""
    gc.collect()  # Python's handles first: they keep the JVM's frames
    spark.sparkContext._jvm.System.gc()


@contextmanager
def together(spark: SparkSession) -> Iterator[None]:
    """Within it, tables dealt by their product meet by product and more without being dealt again."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def grown(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join whose rows grow with the input: it meets the other by sorting, never by broadcast.

    The optimizer takes the size of a file for that of its rows, which are ten times as large or more once decoded,
    and so would gather millions of them in the driver.
    """
    return df.hint("merge")


def clean(spark: SparkSession) -> None:
    """Removes the session's tables; frames that read them are of no use afterwards."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    name = path.rsplit("/", 1)[-1]
    if name.startswith("cut_"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def barrier(df: DataFrame) -> DataFrame:
    """The same rows through a generator of one row each.

    Filters above do not move below it and projections do not merge across it, so an expensive column is
    worked out once, not once for each use of it.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))

"""What several operators of this package share."""

from __future__ import annotations

import functools
import gc
import inspect
import json
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Classes of the task's words: ASCII space and \t \n \v \f \r, nothing else.
SPACE_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) a temporary folder is set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="factloom-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a copy in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def sweep(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of frames that nothing refers to any more: it learns of them only when the
    driver's garbage is collected, which in a quiet driver may be long after."""
    gc.collect()  # Python's handles first: they keep the JVM's frames
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key that more than one in so many rows have is hot; there are fewer than that many hot keys.
HOT = 1000


def hot_join(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the ``facts`` of their key, a row a key; ``count``: the key's rows, ``total``: all rows.

    Facts of hot keys, fewer than ``HOT`` whatever the data, are broadcast, so their rows stay where they are; the rest
    meet by a shuffle, where no key has more than a thousandth of the rows.  ``facts`` is read twice: a written table.
    """
    hot = F.col(count) * HOT > total
    few = F.broadcast(facts.where(hot).drop(count))
    far = rows.join(F.broadcast(facts.where(hot).select(key)), key, "left_anti").join(facts.where(~hot).drop(count), key, how)
    return rows.join(few, key).select(*far.columns).unionByName(far)


def release() -> None:
    """Hands freed memory of a worker back to the system: workers live on between tasks, and several of an executor's
    would else hold what their largest group took."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A worker's function that releases memory after each group."""

    @functools.wraps(run)
    def tidied(*args: object) -> object:
        out = run(*args)
        release()
        return out

    # Spark looks at the arguments: with a key, or of two groups.
    tidied.__signature__ = inspect.signature(run)
    return tidied


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, rest): the other columns in one struct, where their names clash with nothing."""
    rest = [f for f in docs.schema.fields if f.name not in (key, text)]
    none = "__none"
    while none in docs.columns:
        none += "_"
    kind = StructType([StructField(none, IntegerType()), *[StructField(f.name, f.dataType) for f in rest]])  # nullable, as Arrow returns it
    inner = F.struct(F.lit(0).alias(none), *[quoted(f.name) for f in rest]).cast(kind)
    return docs.select(quoted(key).alias("key"), quoted(text).alias("text"), inner.alias("rest"))


def unpacked(df: DataFrame, columns: list[str], key: str, text: str, *more: str | Column) -> DataFrame:
    own = {key: F.col("key"), text: F.col("text")}
    return df.select(*[(own[c] if c in own else F.col("rest")[c]).alias(c) for c in columns], *more)


def constant(values: object, ddl: str) -> Column:
    """A literal of any type from bounded driver-side values; Catalyst folds it once per query."""
    return F.from_json(F.lit(json.dumps(values)), ddl)

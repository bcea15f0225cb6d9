"""Helpers shared by the training-data operators.

Intermediate results that are read more than once are written as Parquet to
the shared folder that the cluster names in ``spark.checkpoint.dir``: a task
that is run again after an executor is lost reads the same committed rows, so
nothing depends on a cache or on the order in which rows were computed.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators define it: the space and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER_ASCII, LOWER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_dirs: dict[str, str] = {}
_paths: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a ``local[...]`` session without that setting gets a temporary
    folder, made here and deleted at exit; on a cluster the setting is needed.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "own" not in _own_dirs:
        _own_dirs["own"] = tempfile.mkdtemp(prefix="mnemospark-")
        atexit.register(shutil.rmtree, _own_dirs["own"], ignore_errors=True)
    return "file://" + _own_dirs["own"]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses, deleted at the driver's end.

    Results are lazy and may read it until then. What a driver that is killed
    leaves behind is named by the label and a unique number.
    """
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _paths:
        atexit.register(_clean, spark)
    _paths.append(path)
    return path


def _clean(spark: SparkSession) -> None:
    for path in _paths:
        if path.startswith(("file:", "/")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
        elif spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            drop_path(spark, path)
    _paths.clear()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table that no later plan reads."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Written:
    """A table in the shared folder: ``df`` reads it, ``drop()`` deletes it."""

    def __init__(self, spark: SparkSession, path: str, df: DataFrame) -> None:
        self.spark, self.path, self.df = spark, path, df

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def write(df: DataFrame, label: str) -> Written:
    """Write ``df`` to the shared folder and read it back from there."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return Written(spark, path, spark.read.schema(df.schema).parquet(path))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[Written], Written]]:
    """Deletes the tables that are written inside at the end, but for those given to the function it yields."""
    before, kept = set(_paths), set()

    def keep(table: Written) -> Written:
        kept.add(table.path)
        return table

    yield keep
    for path in [p for p in _paths if p not in before and p not in kept]:
        drop_path(spark, path)
        _paths.remove(path)


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df``, a written table of short rows, to be broadcast if it has ``most`` rows or fewer, else to be merged."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name


def row_key(df: DataFrame) -> list[Column]:
    """k1 and k2: 128 bits that tell rows apart by the values of all columns; rows that agree in them are equal."""

    def plain(name: str, kind: str) -> list[Column]:
        c = df[f"`{name}`"]
        nested = any(x in kind for x in ("array<", "map<", "struct<"))
        return [F.to_json(F.struct(c)) if nested else c, c.isNull()]

    parts = [x for name, kind in df.dtypes if kind != "void" for x in plain(name, kind)]
    return [F.xxhash64(F.lit(seed), *parts).alias(f"k{seed}") for seed in (1, 2)]


def one_of_each(df: DataFrame) -> DataFrame:
    """(row, k1, k2): each different row of ``df`` once, as a struct.

    Equal rows are dropped before the rows are shuffled, so that many of them
    are no single task's work.
    """
    return df.select(F.struct("*").alias("row"), *row_key(df)).dropDuplicates(["k1", "k2"])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row.

    An alias isn't enough: the optimizer may put its expression into a lambda
    function, where it would be evaluated for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text; an empty array for a null or empty one."""
    return let(
        F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE + "+")),
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n

"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.ship import map_arrow, shared_path, shared_root


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it again: lineage ends there, lost executors cost nothing."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    if _open:
        _open[-1].made.append(out)
    return out


class Scratch:
    """The tables that `saved` wrote while this was the innermost open one."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []
        self.kept: set[str] = set()

    def keep(self, *tables: DataFrame) -> None:
        self.kept |= {t._saved_path for t in tables}


_open: list[Scratch] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Deletes the intermediates written inside at the end, but for those kept, which pass to the one around it."""
    _open.append(own := Scratch())
    try:
        yield own
    finally:
        _open.pop()
        discard(spark, *[t for t in own.made if t._saved_path not in own.kept])
        if _open:
            _open[-1].made += [t for t in own.made if t._saved_path in own.kept]


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete intermediates that nothing reads any more."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "_saved_path", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def even_sample(df: DataFrame, order: Column, rows: int) -> DataFrame:
    """The `rows` rows of smallest `order`, an evenly spread long (a hash).

    Only rows under a bound, about twice as many, leave their tasks, so the driver gets no more however many tasks there are.
    """
    many = df.count()
    bound = F.lit(2 * rows + 64) / F.lit(float(max(1, many)))
    return df.where(order / F.lit(2.0**64) + 0.5 <= bound).orderBy(order).limit(rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["discard", "even_sample", "map_arrow", "saved", "scratch", "shared_path", "shared_root", "table"]

"""Sentences as text lines, JSON objects and Markdown lists: as columns for writers, and as whole strings for a console."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausemill.ship import shared_path

FORMATS = ("text", "json", "markdown")


def text_lines(sentences: DataFrame, order: list[str]) -> DataFrame:
    """value: a trimmed sentence for each row, in order."""
    return sentences.orderBy(*order, "idx").select(F.col("text").alias("value"))


def json_rows(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """keys, idx, value: {"text", "offset", "length"}; offset the byte where the untrimmed sentence starts, length that of the trimmed text in bytes."""
    item = F.struct("text", F.col("start_byte").alias("offset"), F.octet_length("text").cast("long").alias("length"))
    return sentences.select(*keys, "idx", F.to_json(item).alias("value"))


def markdown_rows(sentences: DataFrame, order: list[str], partitions: int | None = None, footer: bool = False) -> DataFrame:
    """n, value: "n. sentence", numbered over all texts in order; with `footer` a last row with their number.

    Numbers come from a range sort that is written to the shared folder with its partition numbers (planned anew they
    could differ), counts of these partitions, and a row number inside each: no task holds all rows.
    """
    sorts = [*order, "idx"]
    ranged = sentences.repartitionByRange(partitions, *sorts) if partitions else sentences.repartitionByRange(*sorts)
    spark, path = sentences.sparkSession, shared_path(sentences.sparkSession, "numbered")
    placed = ranged.select(*sorts, "text", F.spark_partition_id().alias("_part"))
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    counts = placed.groupBy("_part").count()  # a row for each partition
    before = counts.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    n = F.row_number().over(Window.partitionBy("_part").orderBy(*sorts)) + F.col("_before")
    items = placed.join(F.broadcast(before), "_part").select(n.alias("n"), F.concat(n.cast("string"), F.lit(". "), F.col("text")).alias("value"))
    if not footer:
        return items
    total = F.coalesce(F.sum("count"), F.lit(0))
    return items.union(counts.agg((total + 1).alias("n"), F.concat(F.lit("\n---\n*Total sentences: "), total.cast("string"), F.lit("*")).alias("value")))


class Formatter:
    """Whole outputs, over all inputs of a run."""

    def __init__(self, name: str):
        if name not in FORMATS:
            raise ValueError(f"unknown format {name!r}; there are {', '.join(FORMATS)}")
        self.name, self.items, self.n = name, [], 0

    def add(self, found: Iterable[tuple[str, int]]) -> str:
        """What to print now for (sentence, byte offset) pairs."""
        out = []
        for text, offset in found:
            self.n += 1
            if self.name == "json":
                self.items.append({"text": text, "offset": offset, "length": len(text.encode())})
            else:
                out.append(f"{self.n}. {text}\n" if self.name == "markdown" else f"{text}\n")
        return "".join(out)

    def finish(self) -> str:
        if self.name == "json":
            return json.dumps(self.items, ensure_ascii=False, indent=2) + "\n"
        return f"\n---\n*Total sentences: {self.n}*\n" if self.name == "markdown" else ""

"""Functions for Spark SQL: a table function of sentences and a scalar array function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import arrow_udf, pandas_udf, udtf

from clausemill.batch import Scanner, Texts, runs
from clausemill.config import LanguageConfig, supported_languages
from clausemill.kernel import Rules
from clausemill.operators.segment import byte_sizes
from clausemill.ship import ship

_compiled: dict[str, Rules] = {}


def _rules(language: str | None) -> Rules:
    name = language or "en"
    if name not in _compiled:
        _compiled[name] = Rules.of(name)
    return _compiled[name]


class Sentences:
    """sentences(text, lang): a row for each sentence; none for a null text."""

    def eval(self, text: str, lang: str) -> Iterator[tuple]:
        if not text:
            return
        found = _rules(lang).slices(text)
        places = sorted({p for s, e, _ in found for p in (s, e)})
        at = dict(zip(places, byte_sizes(text, places), strict=True))
        for i, (s, e, t) in enumerate(found):
            yield i, t, s, e, at[s], at[e]


def register(spark: SparkSession) -> None:
    """Make `sentences(text, lang)` (a table function), `sentence_array(text, lang)` and `sentence_count(text, lang)` known to SQL."""
    ship(spark)
    spark.udtf.register("sentences", udtf(Sentences, returnType="idx int, text string, start long, end long, start_byte long, end_byte long"))

    @pandas_udf("array<string>")
    def sentence_array(texts: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [x for _, _, x in _rules(lang).slices(t)] for t, lang in zip(texts, langs, strict=True)])

    @pandas_udf("long")
    def sentence_count(texts: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else len(_rules(lang).boundaries(t)) for t, lang in zip(texts, langs, strict=True)], dtype="Int64")

    spark.udf.register("sentence_array", sentence_array)
    spark.udf.register("sentence_count", sentence_count)


def sentences_of(text: Column, language: str | LanguageConfig = "en", preserve_whitespace: bool = False) -> Column:
    """The sentences of a string column as arrays; null for a null text. Texts of a batch are scanned at once."""
    rules = Rules.of(language)
    ship(SparkSession.active())

    @arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        scanner, out = Scanner(rules), []
        for part in runs(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
            t = Texts(part.column("text"))
            found = scanner.slices(t, preserve_whitespace)
            at = np.searchsorted(found.row, np.arange(len(t) + 1)).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(at), found.text, mask=part.column("text").is_null()))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))

    return run(text)


__all__ = ["Sentences", "register", "sentences_of", "supported_languages"]

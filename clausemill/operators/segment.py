"""Sentence operators over DataFrames of texts.

Without a shuffle: each text is scanned where it lies, in Arrow batches, many texts at once. On request texts longer than
`giant` characters are cut into chunks with context on both sides, scanned apart, and their running sums added up by a
window over chunk totals, so that no task owns a giant text. The result never depends on it.

`lang_col` names a column with the language of each row; rows without one, or with one that has no rules, are cut by the
rules of `language`. Null texts have no sentences. Rows that share their keys are still texts of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausemill.batch import Scanner, Texts, runs
from clausemill.config import REACH, LanguageConfig, supported_languages
from clausemill.kernel import Rules, trimmed
from clausemill.ship import map_arrow, shared_path, spread

Language = str | LanguageConfig


def _schema(df: DataFrame, keys: list[str], more: str) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + T._parse_datatype_string(more).fields)


class _Scanners:
    """The scanner of each language that rows name, made when first met."""

    def __init__(self, language: Language, lang_col: str | None):
        self.usual, self.lang_col = Scanner(Rules.of(language)), lang_col
        self.named: dict[str, Scanner] = {}

    def parts(self, batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[Scanner, pa.RecordBatch]]:
        """Runs of the batch's rows, those of a language together."""
        for run in runs(batch, text_col):
            if self.lang_col is None:
                yield self.usual, run
                continue
            langs = np.array([x if x in _BUNDLED else "" for x in run.column(self.lang_col).to_pylist()], object)
            for lang in sorted(set(langs)):
                if lang and lang not in self.named:
                    self.named[lang] = Scanner(Rules.of(lang))
                yield self.named.get(lang, self.usual), run.take(pa.array(np.flatnonzero(langs == lang)))


_BUNDLED = frozenset(supported_languages())


def _narrow(df: DataFrame, keys: list[str], text_col: str, lang_col: str | None) -> DataFrame:
    """Keys, text and language, dealt to all cores if small."""
    if text_col in keys:
        raise ValueError("the text cannot be its own key")
    return spread(df.select(*keys, F.col(text_col), *([lang_col] if lang_col and lang_col not in keys else [])))


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _rows(batch: pa.RecordBatch, keys: list[str], row: np.ndarray, columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    at = pa.array(row)
    made = [x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()]
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *made], names=[*keys, *columns])


def byte_sizes(text: str, places: list[int]) -> list[int]:
    """Byte offsets of ascending character offsets."""
    if text.isascii():
        return places
    out, last, n = [], 0, 0
    for p in places:
        n += len(text[last:p].encode("utf-8", "surrogatepass"))
        last = p
        out.append(n)
    return out


def sentences(df: DataFrame, keys: list[str], language: Language = "en", text_col: str = "text", preserve_whitespace: bool = False, giant: int | None = None, lang_col: str | None = None) -> DataFrame:
    """keys, idx, text, start, end, start_byte, end_byte: a row for each sentence, numbered from 0 in each text.

    start is the end of the sentence before, so it counts the white space that `text` is trimmed of.
    """
    schema = _schema(df, keys, "idx int, text string, start long, end long, start_byte long, end_byte long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = _Scanners(language, lang_col)
        for batch in batches:
            for scanner, part in scanners.parts(batch, text_col):
                t = Texts(part.column(text_col))
                found = scanner.slices(t, preserve_whitespace)
                first, byte_first = t.first[found.row], t.byte_first[found.row]
                yield _rows(part, keys, found.row, {"idx": found.idx.astype(np.int32), "text": found.text, "start": found.start - first, "end": found.end - first, "start_byte": t.bytes_of(found.start) - byte_first, "end_byte": t.bytes_of(found.end) - byte_first})

    narrow = _narrow(df, keys, text_col, lang_col)
    if giant is None:
        return map_arrow(narrow, run, schema)
    usual = map_arrow(narrow.where(F.length(text_col) <= giant), run, schema)
    return usual.unionByName(giant_sentences(narrow.where(F.length(text_col) > giant), keys, language, text_col, preserve_whitespace, lang_col=lang_col))


def boundaries(df: DataFrame, keys: list[str], language: Language = "en", text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """keys, char_offset, offset, is_strong: a row for each sentence end, exclusive, in characters and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = _Scanners(language, lang_col)
        for batch in batches:
            for scanner, part in scanners.parts(batch, text_col):
                t = Texts(part.column(text_col))
                ends, strength = scanner.ends(t)
                row = t.row_of(ends)
                yield _rows(part, keys, row, {"char_offset": ends - t.first[row], "offset": t.bytes_of(ends) - t.byte_first[row], "is_strong": strength == 2})

    return map_arrow(_narrow(df, keys, text_col, lang_col), run, _schema(df, keys, "char_offset long, offset long, is_strong boolean"))


def stats(df: DataFrame, keys: list[str], language: Language = "en", text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """keys, bytes_processed, chars_processed, sentence_count, avg_sentence_length, a row for each text.

    sentence_count counts sentence ends, not an unterminated rest; the average is characters for each of them, 0 if none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = _Scanners(language, lang_col)
        for batch in batches:
            for scanner, part in scanners.parts(batch, text_col):
                t = Texts(part.column(text_col))
                n = np.bincount(t.row_of(scanner.ends(t)[0]), minlength=len(t))
                chars = np.diff(t.first)
                average = np.divide(chars, n, out=np.zeros(len(t)), where=n > 0)
                yield _rows(part, keys, np.arange(len(t)), {"bytes_processed": np.diff(t.byte_first), "chars_processed": chars, "sentence_count": n, "avg_sentence_length": average.astype(np.float32)})

    return map_arrow(_narrow(df, keys, text_col, lang_col), run, _schema(df, keys, "bytes_processed long, chars_processed long, sentence_count long, avg_sentence_length float"))


# Giant texts: scan, prefix sums, filter


def chunks(df: DataFrame, keys: list[str], text_col: str = "text", size: int = 262_144) -> DataFrame:
    """keys, chunk, before, body, after, first: contiguous cuts of `size` characters with their context. Empty texts have none."""
    n = F.length(text_col)
    cut = df.where(n > 0).select(*keys, F.col(text_col).alias("_text"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("chunk"))
    first = F.col("chunk") * size
    piece = lambda a, k: F.substring("_text", (a + 1).cast("int"), k)
    low = F.greatest(first - REACH, F.lit(0))
    return cut.select(*keys, "chunk", piece(low, (first - low).cast("int")).alias("before"), piece(first, F.lit(size)).alias("body"), piece(first + size, F.lit(REACH)).alias("after"), first.cast("long").alias("first"))


def _numbered(df: DataFrame, keys: list[str], text_col: str, lang_col: str | None) -> tuple[DataFrame, list[str]]:
    """df with a number for each row, which with the keys tells rows apart, and the columns that are then keys."""
    held = [*keys, *([lang_col] if lang_col and lang_col not in keys else [])]
    return df.select(*held, text_col, F.monotonically_increasing_id().alias("_row")), [*held, "_row"]


def chunked_boundaries(df: DataFrame, keys: list[str], language: Language = "en", text_col: str = "text", size: int = 262_144, lang_col: str | None = None) -> DataFrame:
    """As `boundaries`, without is_strong, by chunks: scan each, add up what earlier chunks leave open, keep what is outside."""
    numbered, own = _numbered(df, keys, text_col, lang_col)
    states = _states(chunks(numbered, own, text_col, size), own, language, lang_col)
    return _outside(states, own).select(*keys, F.col("char").alias("char_offset"), F.col("byte").alias("offset"))


def _states(parts: DataFrame, keys: list[str], language: Language, lang_col: str | None) -> DataFrame:
    kind = "chunk int, first long, bytes long, depths array<int>, parity long, found array<struct<at:long,byte:long,depths:array<int>,parity:long>>"
    usual = Rules.of(language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = _Scanners(language, lang_col)
        for batch in batches:
            text = pc.binary_join_element_wise(*(batch.column(c) for c in ("before", "body", "after")), "")
            whole = pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "chunk", "first", "before", "body")), text], names=[*keys, "chunk", "first", "before", "body", "_text"])
            for scanner, part in scanners.parts(whole, "_text"):
                t = Texts(part.column("_text"))
                low = t.first[:-1] + pc.utf8_length(part.column("before")).to_numpy(zero_copy_only=False)
                high = low + pc.utf8_length(part.column("body")).to_numpy(zero_copy_only=False)
                s = scanner.states(t, low, high)
                flat = lambda x: _lists(x.shape[1] * np.arange(len(x) + 1), pa.array(x.ravel()))
                first = t.bytes_of(low)
                found = pa.StructArray.from_arrays([pa.array(s.places - low[s.row]), pa.array(t.bytes_of(s.places) - first[s.row]), flat(s.depths), pa.array(s.parity)], names=["at", "byte", "depths", "parity"])
                yield _rows(part, [*keys, "chunk", "first"], np.arange(len(t)), {"bytes": t.bytes_of(high) - first, "depths": flat(s.last_depths), "parity": s.last_parity, "found": _lists(np.searchsorted(s.row, np.arange(len(t) + 1)), found)})

    states = map_arrow(spread(parts), run, T.StructType([parts.schema[k] for k in keys] + T._parse_datatype_string(kind).fields))
    earlier = Window.partitionBy("_row").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    slots = max([usual.n_depths, *(Rules.of(x).n_depths for x in (_BUNDLED if lang_col else ()))])
    depth = F.array(*[F.coalesce(F.sum(F.get("depths", F.lit(i))).over(earlier), F.lit(0)) for i in range(slots)]) if slots else F.array().cast("array<long>")
    return states.select("*", depth.alias("open"), F.coalesce(F.expr("bit_xor(parity)").over(earlier), F.lit(0)).alias("odd"), F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("before_bytes"))


def _outside(states: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates outside every enclosure."""
    each = states.select(*keys, "chunk", "first", "open", "odd", "before_bytes", F.explode("found").alias("c"))
    # a language with fewer enclosures than another has no depths for the rest
    closed = F.forall(F.zip_with("open", "c.depths", lambda a, b: a + F.coalesce(b, F.lit(0))), lambda d: d <= 0)
    return each.where(closed & (F.col("odd").bitwiseXOR(F.col("c.parity")) == 0)).select(*keys, "chunk", (F.col("first") + F.col("c.at")).alias("char"), (F.col("before_bytes") + F.col("c.byte")).alias("byte"))


def giant_sentences(df: DataFrame, keys: list[str], language: Language = "en", text_col: str = "text", preserve_whitespace: bool = False, size: int = 262_144, lang_col: str | None = None) -> DataFrame:
    """As `sentences`, by chunks: each chunk is cut at its own ends, and pieces of a sentence that spans chunks are put together.

    Chunks are written to the shared folder once. Numbers of sentences come from numbers of ends in earlier chunks, so that
    only narrow rows of a text, one for each chunk, meet in a task.
    """
    numbered, own = _numbered(df, keys, text_col, lang_col)
    spark, path = df.sparkSession, shared_path(df.sparkSession, "chunks")
    parts = chunks(numbered, own, text_col, size)
    parts.write.parquet(path)
    parts = spark.read.schema(parts.schema).parquet(path)
    states = _states(parts, own, language, lang_col)
    ends = _outside(states, own).groupBy("_row", "chunk").agg(F.sort_array(F.collect_list(F.struct(F.col("char").alias("at"), "byte"))).alias("ended"))
    none = F.array().cast("array<struct<at:long,byte:long>>")
    sums = states.select("_row", "chunk", "before_bytes", "bytes").join(ends, ["_row", "chunk"], "left").withColumn("ended", F.coalesce("ended", none))
    earlier = Window.partitionBy("_row").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before_ends", F.coalesce(F.sum(F.size("ended")).over(earlier), F.lit(0)))
    held = parts.select(*own, "chunk", "first", "body").join(sums, ["_row", "chunk"])
    last = F.struct((F.col("first") + F.length("body")).alias("at"), (F.col("before_bytes") + F.col("bytes")).alias("byte"))
    head = F.struct(F.col("first").alias("at"), F.col("before_bytes").alias("byte"))
    stops = F.concat("ended", F.when(F.get("ended", F.size("ended") - 1)["at"] == last["at"], none).otherwise(F.array(last)))
    cut = held.withColumn("stops", stops).withColumn("starts", F.concat(F.array(head), F.slice("stops", 1, F.size("stops") - 1)))
    piece = cut.select(*own, "first", "body", "before_ends", F.posexplode(F.arrays_zip("starts", "stops")).alias("i", "p"))
    a, b = F.col("p.starts"), F.col("p.stops")
    text = F.substring("body", (a["at"] - F.col("first") + 1).cast("int"), (b["at"] - a["at"]).cast("int"))
    rows = piece.select(*own, (F.col("before_ends") + F.col("i")).alias("no"), a["at"].alias("a"), b["at"].alias("b"), a["byte"].alias("at_byte"), b["byte"].alias("to_byte"), text.alias("piece"))
    whole = rows.groupBy(*own, "no").agg(F.min("a").alias("start"), F.max("b").alias("end"), F.min("at_byte").alias("start_byte"), F.max("to_byte").alias("end_byte"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", "piece"))), lambda x: x["piece"]), "").alias("raw"))
    kept = whole.withColumn("bare", trim(F.col("raw"))).withColumn("run", F.floor(F.col("no") / 4096))
    # Blank pieces have no number: those before are counted by runs of sentences.
    blank = kept.groupBy("_row", "run").agg(F.sum((F.col("bare") == "").cast("long")).alias("blank"))
    blank = blank.withColumn("blank", F.coalesce(F.sum("blank").over(Window.partitionBy("_row").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("_row", "run").orderBy("no")
    placed = kept.where("bare <> ''").withColumn("at", F.row_number().over(inside)).join(blank, ["_row", "run"])
    idx = F.col("run") * 4096 - F.col("blank") + F.col("at") - 1
    return placed.select(*keys, idx.cast("int").alias("idx"), (F.col("raw") if preserve_whitespace else F.col("bare")).alias("text"), "start", "end", F.col("start_byte").cast("long").alias("start_byte"), F.col("end_byte").cast("long").alias("end_byte"))


def trim(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")


def sentence_arrays(df: DataFrame, language: Language = "en", text_col: str = "text", out_col: str = "sentences", lang_col: str | None = None, preserve_whitespace: bool = False, whole_if_none: bool = False) -> DataFrame:
    """df with an array of (text, start, end) structs; null for a null text.

    `whole_if_none`: a text without sentences has itself, trimmed, as the only one.
    """
    if whole_if_none:
        none = F.array(F.struct(trim(F.col(text_col)).alias("text"), F.lit(0).cast("long").alias("start"), F.length(text_col).cast("long").alias("end")))
        out = sentence_arrays(df, language, text_col, out_col, lang_col, preserve_whitespace)
        return out.withColumn(out_col, F.when(F.size(out_col) == 0, none).otherwise(F.col(out_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = _Scanners(language, lang_col)
        for batch in batches:
            for scanner, part in scanners.parts(batch, text_col):
                t = Texts(part.column(text_col))
                found = scanner.slices(t, preserve_whitespace)
                first = t.first[found.row]
                each = pa.StructArray.from_arrays([found.text, pa.array(found.start - first), pa.array(found.end - first)], names=["text", "start", "end"])
                at = np.searchsorted(found.row, np.arange(len(t) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), each, mask=part.column(text_col).is_null())
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, out_col])

    return map_arrow(spread(df), run, T.StructType([*df.schema.fields, *T._parse_datatype_string(f"{out_col} array<struct<text:string,start:long,end:long>>").fields]))


def single(text: str, language: Language = "en") -> list[str]:
    return [t for _, _, t in Rules.of(language).slices(text)]


__all__ = ["boundaries", "chunked_boundaries", "chunks", "giant_sentences", "sentence_arrays", "sentences", "single", "stats", "trim", "trimmed"]

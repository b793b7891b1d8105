"""SimHash near-duplicates with Golay-code keys.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Of two or fewer differing bits at least one
segment has none, and the next segment at most two. The binary Golay code of length 23 is perfect with radius 3: two
words at distance 2 or less have a neighbour in common (at distance 1 or less from both), so the codeword indices of the
neighbours of each, 1 or 6 of them, share one. A key is the error-free segment with such an index of the next segment:
up to 18 keys a fingerprint. Fingerprints with a common key are joined and verified.

Keys of few fingerprints are joined in pairs. Fingerprints of crowded keys are not: each names itself and its 64
neighbours at one bit; fingerprints that name the same value are within two bits of each other, and any two within two
bits do so, so a star for each value links the same components with a row for each member.

Cases: texts without words (null, empty, blank) have fingerprint zero and link like any other; repeated rows link;
null ids do not count for the smallest id, and a component of only null ids has a null id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausemill.llm.components import components
from clausemill.llm.shared import map_arrow, saved, scratch
from clausemill.llm.tokens import LOWER, NOT_SPACE, pieces, words

SEGMENTS = ((0, 22), (22, 21), (43, 21))
CROWDED = 24
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_GENERATOR = 0b110001110101


def fingerprints_of(texts: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    w = words(texts, NOT_SPACE, lower=True)
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for d in range(len(texts)):
        a, b = w.first[d], w.first[d + 1]
        n = int(b - a)
        if not n:
            continue
        size = w.ends[a:b] - w.starts[a:b]
        to = np.cumsum(size + 1)  # in the text with its words joined by one space
        raw = w.data[w.starts[a] : w.ends[b - 1]].tobytes()
        joined = raw if len(raw) == to[-1] - 1 and not raw.translate(None, _OTHER) else b" ".join(raw.split())
        if n < shingle:
            hashes = np.array([digest(joined, seed)], np.uint64)
        else:
            starts, ends = (to - size - 1)[: n - shingle + 1].tolist(), (to - 1)[shingle - 1 :].tolist()
            hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, ends, strict=True)), np.uint64, n - shingle + 1)
        set_bits = ones(hashes)
        out[d] = np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0]
    return out


#: Bytes other than \x09-\x0D: what is left of a text without them is its other white space.
_OTHER = bytes(i for i in range(256) if not 0x09 <= i <= 0x0D)


def ones(hashes: np.ndarray, run: int = 1 << 14) -> np.ndarray:
    """How many of the values have each of 64 bits."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), run):
        part = hashes[at : at + run].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return total


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, *more: Column) -> DataFrame:
    """(id_col, fp, more), fp the fingerprint as a signed long."""
    narrow = docs.select(id_col, *more, text_col)
    held = [c for c in narrow.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col):
                prints = pa.array(fingerprints_of(part.column(text_col), shingle).view(np.int64))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in held), prints], names=[*held, "fp"])

    return map_arrow(narrow, run, T.StructType([narrow.schema[c] for c in held] + [T.StructField("fp", T.LongType())]))


def _remainder(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64)
    for i in range(22, 10, -1):
        v = np.where(v >> i & 1, v ^ (_GENERATOR << (i - 11)), v)
    return v


@cache
def _leaders() -> np.ndarray:
    """The error of weight 3 or less that each syndrome of the code stands for."""
    table = np.zeros(2048, np.int64)
    one = 1 << np.arange(23, dtype=np.int64)
    errors = [np.zeros(1, np.int64), one]
    errors.append(np.array([a | b for i, a in enumerate(one) for b in one[:i]]))
    errors.append(np.array([a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]))
    for e in map(np.asarray, errors):
        table[_remainder(e)] = e
    return table


def decode(v: np.ndarray) -> np.ndarray:
    """Index of the codeword nearest to each word of 23 bits."""
    return (v.astype(np.int64) ^ _leaders()[_remainder(v)]) >> 11


def golay_keys(v: np.ndarray) -> np.ndarray:
    """An array (n, 24): indices of the codewords nearest to each word and to its 23 neighbours (1 or 6 different ones)."""
    near = v.astype(np.int64)[:, None] ^ np.concatenate([[0], 1 << np.arange(23, dtype=np.int64)])[None, :]
    return decode(near.ravel()).reshape(near.shape)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in fps, key) of all different keys."""
    cut = [(fps >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    places, keys = [], []
    for s in range(3):
        near = np.sort(golay_keys(cut[(s + 1) % 3]), axis=1)
        fresh = np.concatenate([np.ones((len(fps), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
        at, _ = np.nonzero(fresh)
        places.append(at)
        keys.append((np.int64(s) << 40) | (cut[s][at] << 12) | near[fresh])
    return np.concatenate(places), np.concatenate(keys)


def wide_keys(words: np.ndarray, exact: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of all different keys of fingerprints of several words, an array (n, words).

    At every 16th bit of a word: `exact` bits without error and the codeword indices of the next 23, in a circle.
    """
    places, keys = [], []
    for w in range(words.shape[1]):
        for at in range(0, 64, 16):
            turned = words[:, w] >> np.uint64(at) | words[:, w] << np.uint64(-at % 64)
            same = (turned & np.uint64((1 << exact) - 1)).astype(np.int64)
            near = np.sort(golay_keys(turned >> np.uint64(exact) & np.uint64((1 << 23) - 1)), axis=1)
            fresh = np.concatenate([np.ones((len(words), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
            place, _ = np.nonzero(fresh)
            places.append(place)
            keys.append((np.int64(w * 4 + at // 16) << 52) | (same[place] << 12) | near[fresh])
    return np.concatenate(places), np.concatenate(keys)


def links(distinct: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(u, v) pairs of fingerprints at two or fewer bits, enough to connect all that are; `distinct` has a column fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 20_000):
                fps = batch.column("fp").slice(at, 20_000).to_numpy(zero_copy_only=False)
                place, key = keys_of(fps.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[place])], names=["key", "fp"])

    keys = saved(map_arrow(distinct.select("fp"), run, "key long, fp long"), "simhash-keys")
    many = keys.groupBy("key").count().where("count > 1")
    shared = saved(keys.join(many, "key"), "simhash-shared")
    few = shared.where(F.col("count") <= crowded).select("key", "fp")
    pairs = few.alias("a").join(few.alias("b"), "key").where("a.fp < b.fp").where(F.bit_count(F.expr("a.fp ^ b.fp")) <= 2).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    dense = shared.where(F.col("count") > crowded).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    named = dense.withColumn("flip", F.explode(flips)).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    # a hot value cannot be: at most 65 fingerprints name one
    low = named.groupBy("value").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = named.join(low, "value").where("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fingerprint, component_id), a row for each row of docs."""
    return _joined(fingerprints(docs, id_col, text_col, shingle), id_col).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _joined(prints: DataFrame, id_col: str) -> DataFrame:
    """prints (id_col, fp, ...) with component, the smallest fingerprint reachable, and component_id, the smallest id."""
    prints = saved(prints, "simhash-fingerprints")
    distinct = prints.groupBy("fp").agg(F.min(id_col).alias("low"))
    with scratch(prints.sparkSession) as s:
        joined = components(links(distinct), "simhash-components")
        s.keep(joined)
    lows = distinct.join(joined, F.col("fp") == F.col("node"), "left").withColumn("component", F.coalesce("component", "fp"))
    least = lows.groupBy("component").agg(F.min("low").alias("component_id"))
    return prints.join(lows.select("fp", "component").join(least, "component"), "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row of docs, all columns, for each component: that with the smallest id; rows without an id only where no other
    is, and one of rows that repeat."""
    found = _joined(fingerprints(docs, id_col, text_col, shingle, F.xxhash64(text_col).alias("tx")), id_col)
    return one_row(docs, found.select(F.col(id_col).alias("id"), "tx", "component"), id_col, text_col)


def one_row(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each component the row of docs with the smallest id (then of the smallest hash), all columns; rows without an
    id only where no other is. `named` is (id, tx, component), a row for each row of docs."""
    key = lambda i, tx: F.concat(F.when(i.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), i.cast("string"))), F.lit(":"), tx.cast("string"))
    least = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tx")).alias("m"))
    kept = least.select(key(F.col("m.id"), F.col("m.tx")).alias("_row"))
    rows = docs.withColumn("_row", key(F.col(id_col), F.xxhash64(text_col))).join(kept, "_row")
    return rows.withColumn("_no", F.row_number().over(Window.partitionBy("_row").orderBy(F.lit(0)))).where("_no = 1").select(*docs.columns)

"""Packing into optimal length buckets.

Texts are cut into pieces of at most `max_len` tokens, so the global histogram of piece lengths has at most `max_len`
entries whatever the corpus. Dynamic programming over it chooses the bucket boundaries with the least padding. Inside
each bucket, pieces are numbered in hash order and dealt into batches of `token_budget` padded tokens.

`pack` measures lengths in white-space words or any count given; `pack_tokens` cuts texts into the tokens of a public
vocabulary (byte-level BPE, whose file's path is a parameter; read on the driver) and gives each piece's token ids with
its place. Only lengths are numbered; ids meet their places by one join.

Cases: null and empty texts have no tokens and give one piece of length 0, in the first bucket; repeated rows are packed
each; rows without an id count as id '' for the order; an empty table gives an empty result; of columns with other names
only those asked for travel. Pieces with equal keys (copies of a row) are interchangeable.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.shared import map_arrow, saved
from clausemill.llm.tokens import pieces as text_runs

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary splits a text before it merges bytes.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """White-space separated words, the default measure of length; any other count can be given as a column."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("int")


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most `buckets` buckets with the least total padding; of equal splits the leftmost.

    `lengths` ascends. The cost of a bucket meets the quadrangle inequality, so each layer is solved by divide and
    conquer over the split points.
    """
    n = len(lengths)
    if not n:
        return []
    size = np.asarray(lengths, np.int64)
    many = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
    total = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64) * size)])
    best = size * many[1:] - total[1:]  # one bucket for the first i + 1 lengths
    back = [np.zeros(n, np.int64)]
    for _ in range(1, min(buckets, n)):
        layer, cut = best.copy(), np.full(n, -1, np.int64)
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            i = (lo + hi) // 2
            j = np.arange(a, min(b, i - 1) + 1)
            at = a
            if len(j):
                cost = best[j] + size[i] * (many[i + 1] - many[j + 1]) - (total[i + 1] - total[j + 1])
                k = int(np.argmin(cost))
                at = int(j[k])
                if cost[k] < layer[i]:
                    layer[i], cut[i] = cost[k], at
            todo += [(lo, i - 1, a, at), (i + 1, hi, at, b)]
        back.append(cut)
        best = layer
    out, i = [], n - 1
    for cut in reversed(back[1:]):
        out.append(int(size[i]))
        if cut[i] < 0:
            out.pop()
            continue
        i = int(cut[i])
    out.append(int(size[i]))
    return sorted(set(out))


def cut_pieces(docs: DataFrame, tokens: Column, max_len: int, id_col: str = "doc_id") -> DataFrame:
    """(id_col, piece, first_token, n_tokens): whole pieces of max_len and a rest; one empty piece for an empty text."""
    n = F.col("_n")
    last = F.greatest(F.ceil(n / max_len).cast("int") - 1, F.lit(0))
    return (
        docs.select(F.col(id_col), tokens.cast("int").alias("_n"))
        .select(id_col, "_n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
        .select(id_col, "piece", (F.col("piece").cast("long") * max_len).alias("first_token"), F.least(n - F.col("piece") * max_len, F.lit(max_len)).alias("n_tokens"))
    )


@cache
def encoder(ranks: bytes):
    """The tokenizer of a file of ranks (its content), made once in a process."""
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=merges, special_tokens={})


def cut_tokens(docs: DataFrame, max_len: int, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, first_token, n_tokens, token_ids): whole pieces of max_len tokens and a rest; one empty piece for an empty text."""
    with open(path, "rb") as f:
        ranks = f.read()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(ranks)
        for batch in batches:
            for part in text_runs(batch, text_col):
                ids = [tokens.encode_to_numpy(t or "", disallowed_special=()) for t in part.column(text_col).to_pylist()]
                size = np.array(list(map(len, ids)), np.int64)
                many = np.maximum(1, -(-size // max_len))
                row = np.repeat(np.arange(len(ids)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                n = np.minimum(size[row] - piece * max_len, max_len)
                flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([part.column(id_col).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * max_len), pa.array(n.astype(np.int32)), lists], names=[id_col, "piece", "first_token", "n_tokens", "token_ids"])

    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, piece int, first_token long, n_tokens int, token_ids array<int>")


def pack_tokens(docs: DataFrame, path: str = VOCABULARY, max_len: int = 2048, buckets: int = 8, token_budget: int = 65536, id_col: str = "doc_id", text_col: str = "text", shards: int = 256) -> DataFrame:
    """As `pack`, of the vocabulary's tokens, with token_ids, the ids of each piece."""
    pieces = saved(cut_tokens(docs, max_len, path, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "pack-tokens")
    placed = _placed(pieces.drop("token_ids"), max_len, buckets, token_budget, id_col, shards, ["_row"])
    return placed.join(pieces.select("_row", "token_ids"), "_row").drop("_row")


def pack(docs: DataFrame, tokens: Column | None = None, max_len: int = 2048, buckets: int = 8, token_budget: int = 65536, id_col: str = "doc_id", shards: int = 256) -> DataFrame:
    """(id_col, piece, first_token, n_tokens, bucket, bucket_len, batch, slot), a row for each piece.

    A batch holds token_budget // bucket_len pieces, one at least. Numbers inside a bucket come from counts for each of
    `shards` ranges of the hash, so no task holds a bucket; the result does not depend on `shards`.
    """
    tokens = word_count(F.col("text")) if tokens is None else tokens
    return _placed(saved(cut_pieces(docs, tokens, max_len, id_col), "pack-pieces"), max_len, buckets, token_budget, id_col, shards, [])


def _placed(pieces: DataFrame, max_len: int, buckets: int, token_budget: int, id_col: str, shards: int, more: list[str]) -> DataFrame:
    """Pieces (id_col, piece, first_token, n_tokens, `more`) with bucket, bucket_len, batch and slot; equal keys in order of `more`."""
    histogram = sorted(map(tuple, pieces.groupBy("n_tokens").count().collect()))  # max_len + 1 rows at most
    ends = boundaries([x[0] for x in histogram], [x[1] for x in histogram], buckets) or [max_len]
    bucket = F.lit(len(ends) - 1)
    for i, end in reversed(list(enumerate(ends[:-1]))):
        bucket = F.when(F.col("n_tokens") <= end, i).otherwise(bucket)
    order = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), "piece"))
    shard = F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * shards / (1 << 32)).cast("int")
    dealt = pieces.withColumn("bucket", bucket).withColumn("order", order).withColumn("shard", shard)
    counts = dealt.groupBy("bucket", "shard").count()  # buckets x shards rows at most
    before = F.sum("count").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("bucket", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    place = Window.partitionBy("bucket", "shard").orderBy("order", "n_tokens", *more)
    numbered = dealt.withColumn("at", F.row_number().over(place)).join(F.broadcast(base), ["bucket", "shard"])
    at = F.col("before") + F.col("at") - 1
    length = F.element_at(F.array(*map(F.lit, ends)), F.col("bucket") + 1)
    room = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(length, F.lit(1)))).cast("long")
    return numbered.select(*more, id_col, "piece", "first_token", "n_tokens", "bucket", length.alias("bucket_len"), F.floor(at / room).cast("long").alias("batch"), (at % room).cast("long").alias("slot"))

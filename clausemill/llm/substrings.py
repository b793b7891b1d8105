"""Substring dedup by Rabin-Karp hashes of every window of `size` words.

A window is removed if its words also start, in the same order, in a document with a smaller id. Windows are dealt by
hash to buckets, where the smallest id of each hash is found; what is removed goes back to its document, whose removed
windows merge into maximal intervals.

Before windows travel, each run of texts (about `run_bytes`) settles what it can: of equal windows in it only those of
its smallest id are sent, the others are removed for certain. So however many documents share a passage, each run sends
it for one document. Windows travel packed, about nine bytes each, and texts compressed.

A window has two Rabin-Karp hashes of 64 bits, over two independent hashes of its words. One run compares both. Between
runs, windows are equal if they agree in the first hash, in the bucket (leading bits of the second) and in eight more bits
of the second: 72 bits and one for each doubling of the number of buckets. So of n windows, which have n / 1.5 million
buckets, two unequal ones meet with a probability of n / 2**53: one in a million at 30 GB of text, one in 500 at 100 TB.

A passage that every run has sends a row for each run to one bucket. Beyond 2**16 runs buckets are settled in two steps,
first in parts of so many runs, of which only the smallest id goes on; the result is the same.

Cases: null and empty texts have no words; a row without an id keeps all its words and removes none elsewhere; of rows
with one id none removes the other, and each is judged by its own text; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.shared import map_arrow
from clausemill.llm.tokens import Words, mixed, pieces, raw, words

_BASE = np.uint64(0xBF58476D1CE4E5B9)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of the window at each word, text ends not regarded: sum of h[i + j] * base ** (size - 1 - j)."""
    n = len(h) - size + 1
    total = np.zeros(max(0, n), np.uint64)
    for j in range(size):
        total = total * _BASE + h[j : j + len(total)]
    return mixed(total)


def window_starts(w: Words, size: int) -> np.ndarray:
    """Words at which a window of their own text starts."""
    many = np.maximum(w.counts() - size + 1, 0)
    return np.repeat(w.first[:-1] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


def planes(a: np.ndarray) -> bytes:
    """Bytes of the numbers by significance: planes of equal bytes compress well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def unplanes(b: bytes, kind: str, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(-1, n).T).view(kind).ravel() if n else np.zeros(0, kind)


def encode(ids: np.ndarray, tags: np.ndarray, at: np.ndarray, extra: list[np.ndarray]) -> bytes:
    """Rows (id, tag, place, hashes); small where those of one text stand together, by place."""
    fresh = np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]) | (at[1:] < at[:-1])]) if len(ids) else np.zeros(0, bool)
    heads = np.flatnonzero(fresh)
    step = np.diff(at, prepend=0)
    step[heads] = at[heads]
    parts = [planes(np.diff(ids[heads], prepend=0)), planes(tags[heads]), planes(np.diff(np.append(heads, len(ids))).astype(np.uint32)), planes(step.astype(np.uint32))]
    body = b"".join([*parts, *map(planes, extra)])
    return np.array([len(ids), len(heads), len(extra)], np.uint32).tobytes() + body


#: Types of what encode() may have as `extra`: the first hash and eight bits of the second.
_EXTRA = ("<u8", "<u1")


def decode(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    n, heads, extra = map(int, np.frombuffer(b[:12], np.uint32))
    at, out = 12, []
    for kind, many in (("<i8", heads), ("<u4", heads), ("<u4", heads), ("<u4", n), *[(k, n) for k in _EXTRA[:extra]]):
        size = many * int(kind[2])
        out.append(unplanes(b[at : at + size], kind, many))
        at += size
    ids, tags, runs, step, *hashes = out
    ids = np.cumsum(ids)
    run = np.repeat(np.arange(heads), runs)
    place = np.cumsum(step.astype(np.int64))
    first = np.cumsum(runs, dtype=np.int64) - runs
    place -= np.where(first > 0, place[first - 1], 0)[run] if heads else 0
    return ids[run], tags[run], place, hashes


def tags_of(column: pa.Array) -> np.ndarray:
    """32 bits of each text, to tell apart rows that share an id."""
    data, offsets = raw(column)
    return np.fromiter((xxhash.xxh32_intdigest(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.uint32, len(column))


def _group(ids: np.ndarray, groups: int) -> np.ndarray:
    return (mixed(ids.view(np.uint64)) % np.uint64(groups)).astype(np.int32)


def _by(key: np.ndarray, ids, tags, at, extra) -> Iterator[tuple[int, bytes]]:
    """Packed rows of each key, in the order given inside a key."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")  # radix sort for keys of 16 bits
    cuts = np.flatnonzero(np.diff(key[order], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        o = order[a:b]
        yield int(key[o[0]]), encode(ids[o], tags[o], at[o], [x[o] for x in extra])


def _small(key: np.ndarray, most: int) -> np.ndarray:
    return key.astype(np.int16) if most < 1 << 15 else key.astype(np.int32)


def classes(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal windows stand together, and the places in it where a class begins."""
    order = np.argsort(first)
    a, b = first[order], second[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(fresh)


def above_least(value: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Which windows have an equal one of smaller value."""
    out = np.zeros(len(value), bool)
    if len(value):
        order, heads = classes(first, second)
        low = np.repeat(np.minimum.reduceat(value[order], heads), np.diff(np.append(heads, len(value))))
        out[order] = value[order] > low
    return out


def pack_windows(part: pa.RecordBatch, id_col: str, text_col: str, size: int, buckets: int, groups: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, group, payload): windows for a bucket (group -1), or places that are removed already, for a group."""
    part = part.filter(part.column(id_col).is_valid())
    ids = part.column(id_col).cast(pa.int64()).to_numpy(zero_copy_only=False)
    w = words(part.column(text_col))
    start = window_starts(w, size)
    if not len(start):
        return
    tags = tags_of(part.column(text_col))
    first, second = (window_hashes(w.hashes(seed), size)[start] for seed in (0, 1))
    doc = w.doc[start]
    at = start - w.first[doc]
    gone = above_least(np.unique(ids, return_inverse=True)[1][doc], first, second)
    kept = np.flatnonzero(~gone)
    bucket = _small((second[kept] >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64) if buckets > 1 else np.zeros(len(kept), np.int64), buckets)
    for key, payload in _by(bucket, ids[doc[kept]], tags[doc[kept]], at[kept], [first[kept], second[kept].astype(np.uint8)]):
        yield key, -1, payload
    lost = np.flatnonzero(gone)
    group = _group(ids[doc[lost]], groups)
    for key, payload in _by(group, ids[doc[lost]], tags[doc[lost]], at[lost], []):
        yield key % buckets, key, payload


def settle(payloads: list[bytes]) -> tuple[tuple, tuple]:
    """(id, tag, place, hashes) of the windows of a bucket of which another has a smaller id, and of the others."""
    parts = [decode(p) for p in payloads]
    ids, tags, at = (np.concatenate([p[k] for p in parts]) for k in range(3))
    hashes = [np.concatenate([p[3][k] for p in parts]) for k in range(len(_EXTRA))]
    del parts
    gone = above_least(ids, *hashes)
    return tuple((ids[m], tags[m], at[m], [x[m] for x in hashes]) for m in (np.flatnonzero(gone), np.flatnonzero(~gone)))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13, run_bytes: int = 2_500_000, bucket_windows: int = 1_500_000, group_bytes: int = 24_000_000, part_runs: int = 1 << 16) -> DataFrame:
    """(id_col, n_words, n_removed, kept, kept_sha256, intervals), a row for each row of docs; ids are integers.

    intervals: the maximal removed runs of words, [first, end). bucket_windows and group_bytes bound what a task holds.
    """
    total = docs.agg(F.sum(F.octet_length(text_col))).collect()[0][0] or 0
    buckets = 1 << max(0, int(total // 6 // bucket_windows).bit_length())
    groups = int(total // group_bytes) + 1
    salts = int(total // run_bytes // part_runs) + 1
    kind = docs.schema[id_col].dataType.simpleString()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col, run_bytes):
                rows = list(pack_windows(part, id_col, text_col, size, buckets, groups))
                if rows:
                    b, g, p = zip(*rows, strict=True)
                    salt = xxhash.xxh32_intdigest(repr(part.column(id_col)[0])) % salts
                    yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([salt] * len(b), pa.int32()), pa.array(g, pa.int32()), pa.array(p, pa.binary())], names=["bucket", "salt", "grp", "payload"])

    def in_bucket(t: pa.Table, last: bool) -> pa.Table:
        payload, grp, bucket = t.column("payload"), t.column("grp").to_pylist(), t.column("bucket")[0].as_py()
        out = [(g, payload[i].as_py()) for i, g in enumerate(grp) if g >= 0]
        own = [payload[i].as_py() for i, g in enumerate(grp) if g < 0]
        if own:
            gone, rest = settle(own)
            out += _by(_group(gone[0], groups), *gone[:3], [])
            out += [] if last else [(-1, encode(*rest))]
        return pa.table({"bucket": pa.array([bucket] * len(out), pa.int32()), "grp": pa.array([g for g, _ in out], pa.int32()), "payload": pa.array([p for _, p in out], pa.binary())})

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in pieces(batch, text_col, run_bytes):
                ids = part.column(id_col).cast(pa.int64())
                column = part.column(text_col)
                data, offsets = raw(column)
                group = _group(ids.fill_null(0).to_numpy(zero_copy_only=False), groups)
                rows = []
                for g in np.unique(group):
                    mine = np.flatnonzero(group == g)
                    rows.append((int(g), ids.take(pa.array(mine)).to_pylist(), (offsets[mine + 1] - offsets[mine]).tolist(), pack.compress(b"".join(data[offsets[i] : offsets[i + 1]].tobytes() for i in mine))))
                g, i, n, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(i, pa.list_(pa.int64())), pa.array(n, pa.list_(pa.int64())), pa.array(b, pa.binary())], names=["grp", "ids", "sizes", "blob"])

    def in_group(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        cut = _cuts([p.as_py() for p in right.column("payload")])
        unpack = zstandard.ZstdDecompressor()
        out: dict[str, list] = {k: [] for k in ("id", "n_words", "n_removed", "kept_sha256", "intervals")}
        for ids, sizes, blob in zip(left.column("ids"), left.column("sizes"), left.column("blob"), strict=True):
            data, at = unpack.decompress(blob.as_py()), 0
            for i, n in zip(ids.as_py(), sizes.as_py(), strict=True):
                text, at = data[at : at + n], at + n
                own, removed = text.split(), 0  # of bytes, split() knows \x20 and \x09-\x0D only
                spans: list[dict] = []
                if i is not None and (places := cut.get((i, xxhash.xxh32_intdigest(text)))) is not None:
                    change = np.zeros(len(own) + 1, np.int32)
                    np.add.at(change, places, 1)
                    np.add.at(change, places + size, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    removed = int(gone.sum())
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                    spans = [{"first": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]
                    kept = list(compress(own, (~gone).tolist()))
                else:
                    kept = own
                for k, v in zip(out, (i, len(own), removed, hashlib.sha256(b" ".join(kept)).hexdigest(), spans), strict=True):
                    out[k].append(v)
        return pa.table({"id": pa.array(out["id"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "intervals": pa.array(out["intervals"], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))})

    narrow = docs.select(id_col, text_col)
    sent = map_arrow(narrow, windows, "bucket int, salt int, grp int, payload binary")
    row = "bucket int, grp int, payload binary"
    if salts > 1:
        sent = sent.groupBy("bucket", "salt").applyInArrow(lambda t: in_bucket(t, False), row)
    removed = sent.groupBy("bucket").applyInArrow(lambda t: in_bucket(t, True), row).drop("bucket")
    packed = map_arrow(narrow, texts, "grp int, ids array<long>, sizes array<long>, blob binary")
    out = packed.groupBy("grp").cogroup(removed.groupBy("grp")).applyInArrow(in_group, "id long, n_words long, n_removed long, kept_sha256 string, intervals array<struct<first:long,end:long>>")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_words", "n_removed", "kept_sha256", "intervals")


def _cuts(payloads: list[bytes]) -> dict[tuple[int, int], np.ndarray]:
    """Places of removed windows of each text."""
    if not payloads:
        return {}
    parts = [decode(p)[:3] for p in payloads]
    ids, tags, at = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.lexsort((at, tags, ids))
    ids, tags, at = ids[order], tags[order], at[order]
    heads = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])])) if len(ids) else np.zeros(0, np.int64)
    return {(int(ids[a]), int(tags[a])): np.unique(at[a:b]) for a, b in zip(heads, np.append(heads[1:], len(ids)), strict=True)}

"""Near copies of texts by SimHash with Golay-code keys, then by word shingles: all pairs of Jaccard similarity 0.8 or more.

A text is the set of hashes of its five-word shingles. Texts of `SMALL` shingles or more that could be similar are told by
a SimHash fingerprint of 256 bits, of which similar sets differ in 39 on average at similarity 0.8 (standard deviation 6) and
`RADIUS` = 80 are let through; what is left is verified on the sets themselves.

First texts meet by the Golay keys of their fingerprints (`simhash.wide_keys`): each is paired with the first text of each
of its keys, pairs are verified, and texts linked to the same first one are a part. Keys miss some pairs, so an exact way
follows for the rest: of two sets of similarity s each shares one of its first n - ceil(s n) + 1 hashes, in one order of all
hashes, with the other (prefix filter). Texts of different parts with such a hash in common are compared in the same manner.

Which order is taken does not change the result, only how many texts meet. Common hashes come last, those of most texts
behind all others: a line that many texts have is then a key of a text only if four fifths of its hashes are as common.
In the order of the hashes alone every shared line is a crowded key, whose work grows with the square of its texts. Which
hashes are common is counted in the texts of one in `SHARE` values of their hash; every text has its keys either way.

Hashes of few texts are joined in pairs. Texts of a crowded hash are linked in one task, where a text is compared only with
texts of other components, those in the middle of the group first.

Cases: texts without words (null, empty, blank) are copies of each other; shorter texts than a shingle are one shingle;
repeated rows count as copies; rows with an id are kept before rows without; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.components import components
from clausemill.llm.shared import map_arrow, saved, scratch
from clausemill.llm.simhash import one_row, ones, wide_keys
from clausemill.llm.tokens import NOT_SPACE, mixed, pieces, powers, words

CROWDED, SMALL, RADIUS = 64, 32, 80
#: One in so many texts is counted for common shingles; those of `LEAST` counted texts or more are common, `MOST` at most.
SHARE, LEAST, MOST = 16, 8, 100_000
_STEP = 0x8CB92BA72F3D8DD7
_PARTS = tuple(np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_PRINT = ("f0", "f1", "f2", "f3")


def shingles_of(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of the shingles of each text, words in lower case."""
    w = words(texts, NOT_SPACE, lower=True)
    h, weights = w.hashes(), powers(_STEP, size + 1)
    total = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size):
        total += h[j : j + len(total)] * weights[j]
    total, out = mixed(total), []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(total[a : b - size + 1]))
        else:
            out.append(mixed((h[a:b] * weights[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


class Common:
    """Common hashes and their places in the order, from 1 on; all others have place 0."""

    def __init__(self, hashes: np.ndarray = np.zeros(0, np.uint64)):
        order = np.argsort(hashes)
        self.hashes, self.place = hashes[order], order + 1

    def places(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(shingles), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, shingles), len(self.hashes) - 1)
        return np.where(self.hashes[at] == shingles, self.place[at], 0)


def common_shingles(docs: DataFrame, text_col: str, shingle: int) -> Common:
    """The shingles that many texts have, those of most texts last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingles_of(part.column(text_col), shingle)).view(np.int64))], names=["hash"])

    texts = docs.select(text_col, F.xxhash64(text_col).alias("_tx")).where(f"pmod(_tx, {SHARE}) = 0").dropDuplicates(["_tx"]).select(text_col)
    counted = map_arrow(texts, run, "hash long").groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)
    found = counted.orderBy(F.desc("n"), "hash").limit(MOST).toArrow()
    return Common(found.column("hash").to_numpy()[::-1].copy().view(np.uint64))


def keys_of(shingles: np.ndarray, similarity: float, common: Common = Common()) -> np.ndarray:
    n = len(shingles)
    first = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
    if not common.places(shingles[:first]).any():
        return shingles[:first]
    return shingles[np.argsort(common.places(shingles), kind="stable")[:first]]


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """256 bits as four words: in each the bits that most hashes have."""
    return np.concatenate([np.packbits(2 * ones(mixed(shingles ^ p)) > len(shingles), bitorder="little").view("<u8") for p in _PARTS])


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """`fingerprint` of each set, all at once: an array (n, 4)."""
    out, size = np.zeros((len(sets), len(_PARTS)), np.uint64), np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    flat, size = np.concatenate([sets[i] for i in full.tolist()]), size[full]
    # Bytes count up to 255 hashes each: eight bits of every byte of the hashes, one after the other.
    runs = -(-size // 255)
    first = np.concatenate([[0], np.cumsum(runs)[:-1]])
    nth = np.arange(runs.sum()) - np.repeat(first, runs)
    starts = np.repeat(np.cumsum(size) - size, runs) + 255 * nth
    for j, p in enumerate(_PARTS):
        h, more = mixed(flat ^ p), np.zeros((len(full), 8, 8), bool)
        for bit in range(8):
            lanes = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(0x0101010101010101), starts)
            total = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
            more[:, :, bit] = 2 * total > size[:, None]
        out[full, j] = np.packbits(more.reshape(len(full), 64), axis=1, bitorder="little").view("<u8").ravel()
    return out


def _sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, common: Common = Common()) -> DataFrame:
    """(id, tx, node, n, f0..f3, keys), a row for each row of docs; tx hashes the text, node the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col):
                sets = shingles_of(part.column(text_col), shingle)
                prints = fingerprints(sets).view(np.int64)
                node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                keys = pa.array([keys_of(s, similarity, common).view(np.int64) for s in sets], pa.list_(pa.int64()))
                columns = [part.column(id_col), part.column("_tx"), pa.array(node), pa.array(list(map(len, sets)), pa.int32()), *[pa.array(prints[:, j]) for j in range(4)], keys]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "tx", "node", "n", *_PRINT, "keys"])

    texts = docs.select(id_col, F.xxhash64(text_col).alias("_tx"), text_col)
    return map_arrow(texts, run, f"id {docs.schema[id_col].dataType.simpleString()}, tx long, node long, n int, f0 long, f1 long, f2 long, f3 long, keys array<long>")


def golay_pairs(prints: DataFrame) -> DataFrame:
    """(u, v) pairs of nodes of prints (node, f0..f3): each text with the first of each of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 5_000):
                part = batch.slice(at, 5_000)
                place, key = wide_keys(np.stack([part.column(f).to_numpy() for f in _PRINT], axis=1).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), part.column("node").take(pa.array(place))], names=["key", "node"])

    keyed = map_arrow(prints.select("node", *_PRINT), run, "key long, node long")
    least = F.min("node").over(Window.partitionBy("key"))
    return keyed.select(least.alias("u"), F.col("node").alias("v")).where("u <> v").distinct()


def _sets(docs: DataFrame, chosen: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(node, shingles) of the texts whose hash is in chosen (tx, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col):
                sets = pa.array([s.view(np.int64) for s in shingles_of(part.column(text_col), shingle)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("node"), sets], names=["node", "shingles"])

    texts = docs.select(F.xxhash64(text_col).alias("tx"), text_col).join(chosen, "tx").select("node", text_col)
    return map_arrow(texts, run, "node long, shingles array<long>").dropDuplicates(["node"])


def has_near(prints: np.ndarray, size: np.ndarray, similarity: float, part: np.ndarray) -> np.ndarray:
    """Which sets have one of another part in the group that size and fingerprint do not rule out."""
    out = np.zeros(len(size), bool)
    if (part == part[0]).all():
        return out
    order = np.argsort(size, kind="stable")
    prints, size, part = prints.view(np.uint64)[order], size[order], part[order]
    # Each is compared with those behind it, up to the largest size that may be similar and one more.
    to = np.searchsorted(size, size / similarity + 1, side="right").tolist()
    for p in range(len(size) - 1):
        at = slice(p, to[p])
        found = _near(prints[at], size[at], 0, similarity) & (part[at] != part[p])
        if found.any():
            out[p] = True
            out[at] |= found
    back = np.zeros(len(size), bool)
    back[order] = out
    return back


def _near(prints: np.ndarray, size: np.ndarray, p: int, similarity: float) -> np.ndarray:
    low, high = np.minimum(size, size[p]), np.maximum(size, size[p])
    return (low >= similarity * high - 1e-9) & ((low < SMALL) | (np.bitwise_count(prints ^ prints[p]).sum(axis=1) <= RADIUS))


def group_links(node: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], similarity: float, part: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of similar sets of one group, enough to connect all that are; sets of one `part` are connected already."""
    n, prints = len(node), prints.view(np.uint64)  # of negative numbers numpy counts the bits of their amount
    size = np.array([len(s) for s in sets])
    start = np.concatenate([[0], np.cumsum(size)])
    _, flat, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    has = np.zeros(len(many), bool)
    middle = np.add.reduceat(many[flat], start[:-1]) / size
    part = np.arange(n) if part is None else np.unique(part, return_inverse=True)[1]
    done, out = np.zeros(n, bool), []
    order = np.argsort(-middle, kind="stable").tolist()
    largest = int(np.bincount(part).argmax())
    while order:
        for p in order:
            if part[p] == largest and done.any():
                continue
            done[p] = True
            at = np.flatnonzero((part != part[p]) & _near(prints, size, p, similarity))
            if not len(at):
                continue
            has[flat[start[p] : start[p + 1]]] = True
            if len(at) * 20 > n:
                both = np.add.reduceat(has[flat], start[:-1], dtype=np.int64)[at]
            else:
                both = np.array([np.count_nonzero(has[flat[start[i] : start[i + 1]]]) for i in at])
            has[flat[start[p] : start[p + 1]]] = False
            at = at[both >= similarity * (size[at] + size[p] - both) - 1e-9]
            if len(at):
                met, first = np.unique(part[at], return_index=True)
                out += [(int(node[p]), int(node[at[i]])) for i in first]
                part[np.isin(part, met)] = part[p]
                largest = int(np.bincount(part).argmax())
        # Texts that were passed over are in what was the largest component then: those that are not in it now have their turn.
        order = [p for p in order if not done[p] and part[p] != largest]
    return out


def _alike(similarity: float) -> str:
    """Of two rows a and b with n and a fingerprint: whether size and fingerprint let them through."""
    far = " + ".join(f"bit_count(a.{f} ^ b.{f})" for f in _PRINT)
    return f"least(a.n, b.n) >= {similarity} * greatest(a.n, b.n) - 1e-9 AND (least(a.n, b.n) < {SMALL} OR {far} <= {RADIUS})"


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of which the sets are similar."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("y")), "v")
    both = both.withColumn("both", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("both") >= similarity * (F.size("x") + F.size("y") - F.col("both")) - 1e-9).select("u", "v")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()


def links(docs: DataFrame, sketches: DataFrame, text_col: str, shingle: int, similarity: float, crowded: int) -> DataFrame:
    """(u, v) pairs of nodes, enough to connect all of similarity `similarity` or more, and no others."""
    prints = saved(sketches.select("node", "tx", "n", *_PRINT).dropDuplicates(["node"]), "near-prints")
    a, b = prints.withColumnRenamed("node", "u").alias("a"), prints.withColumnRenamed("node", "v").alias("b")
    met = golay_pairs(prints).join(a, "u").join(b, "v").where(_alike(similarity)).select("u", "v")
    met = saved(met, "near-golay-pairs")
    first = saved(_sets(docs, prints.select("tx", "node").join(_ends(met), "node", "left_semi"), text_col, shingle), "near-golay-sets")
    found = saved(_verified(met, first, similarity), "near-golay-links")
    # Not whole components, which take many jobs: texts of one part must be connected, not all connected ones in one part.
    parts = found.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("part"))
    return found.union(_rest(docs, sketches, prints, parts, first, text_col, shingle, similarity, crowded))


def _rest(docs: DataFrame, sketches: DataFrame, prints: DataFrame, parts: DataFrame, first: DataFrame, text_col: str, shingle: int, similarity: float, crowded: int) -> DataFrame:
    """(u, v) pairs of nodes of similarity `similarity` or more, enough to connect all that are in different `parts`
    (node, part; other nodes are parts of their own); `first` are sets known already."""
    parts = prints.join(parts, "node", "left").select("node", "n", *_PRINT, F.coalesce("part", "node").alias("part"))
    keyed = sketches.dropDuplicates(["node"]).select("node", F.explode("keys").alias("key"))
    many = keyed.withColumn("count", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("count > 1")
    shared = saved(many.join(parts, "node"), "near-shared")
    few = shared.where(F.col("count") <= crowded)
    pairs = few.alias("a").join(few.alias("b"), "key").where(f"a.node < b.node AND a.part <> b.part AND {_alike(similarity)}").select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
    pairs = saved(pairs, "near-pairs")

    def alone(table: pa.Table) -> pa.Table:
        prints = np.stack([table.column(f).to_numpy() for f in _PRINT], axis=1)
        return table.filter(pa.array(has_near(prints, table.column("n").to_numpy(), similarity, table.column("part").to_numpy())))

    # Most texts of a crowded key have only a line in common: their sets need not travel.
    crowd = shared.where(F.col("count") > crowded).select("key", "node", "n", *_PRINT, "part")
    dense = saved(crowd.groupBy("key").applyInArrow(alone, crowd.schema), "near-dense")
    wanted = _ends(pairs).union(dense.select("node")).distinct().join(first.select("node"), "node", "left_anti")
    # a text of each wanted set
    chosen = saved(prints.select("tx", "node").join(wanted, "node", "left_semi"), "near-chosen")
    sets = first.union(saved(_sets(docs, chosen, text_col, shingle), "near-sets"))

    def run(table: pa.Table) -> pa.Table:
        prints = np.stack([table.column(f).to_numpy() for f in _PRINT], axis=1)
        sets = [s.values.to_numpy() for s in table.column("shingles")]
        found = group_links(table.column("node").to_numpy(), prints, sets, similarity, table.column("part").to_numpy())
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return _verified(pairs, sets, similarity).union(dense.join(sets, "node").groupBy("key").applyInArrow(run, "u long, v long"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, crowded: int = CROWDED) -> DataFrame:
    """One row of docs, all columns, for each component of texts linked at `similarity`: that with the smallest id."""
    sketches = saved(_sketches(docs, id_col, text_col, shingle, similarity, common_shingles(docs, text_col, shingle)), "near-sketches")
    with scratch(docs.sparkSession) as s:
        joined = components(links(docs, sketches, text_col, shingle, similarity, crowded), "near-components")
        s.keep(joined)
    named = sketches.select("id", "tx", "node").join(joined, "node", "left").select("id", "tx", F.coalesce("component", "node").alias("component"))
    return one_row(docs, named, id_col, text_col)

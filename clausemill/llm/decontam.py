"""Benchmark decontamination by spaced seeds.

Fixed masks pick some positions of a window of tokens and ignore the others, so a window hashes alike although ignored
tokens were substituted. Hashes of test and training windows are joined; around each hit the two texts are compared
token by token on the hit's diagonal, and the longest stretch with at least `similarity` equal tokens is kept.

The test set is used in blocks of at most `block_windows` windows (the bound of what is sent to executors, whatever its
size); every block meets all documents.

Items of `least` tokens at most are compared whole: cut into one run more than the tokens that may be substituted, of
which one must be equal, so that no copy is missed. The masks miss no overlap of longer items either: one of them meets no
substitution in any stretch of `least` tokens or more of which four fifths are equal.

Hits are expanded in bounded runs and held once for each diagonal, so that texts and items of repeated tokens take time
but no memory. The best overlap of a text and an item is the longest, then that with most equal tokens, then the first.

Cases: null and empty texts match nothing; items count from one token on unless `least_item` asks for more; texts of any
length and of one repeated token are compared whole; repeated rows and ties are all reported; empty tables give an empty
result; columns beside ids and texts are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.shared import map_arrow
from clausemill.llm.tokens import ALNUM, Words, mixed, pieces, powers, words

#: Of every 13 tokens with 2 substituted, 15 with 3, 20 with 4 and 25 with 5, one of these meets none of the substituted
#: ones. Longer stretches hold one of these: of two halves one has its share of substitutions at most.
MASKS = ("1111011", "110100010011", "110101011", "1110111")
_STEP = 0xD1B54A32D192ED03


def _fold(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.fill_null("") if texts.null_count else texts)


def seed_hashes(h: np.ndarray, first: np.ndarray, mask: str, no: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window at each place where it fits into its text, and these places."""
    span = len(mask)
    if len(h) < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(h) - span + 1
    total = np.full(n, np.uint64(no + 1))
    weights = powers(_STEP, span + 1)
    for j, c in enumerate(mask):
        if c == "1":
            total += h[j : j + n] * weights[j]
    fits = np.zeros(len(h) + 1, np.int64)  # windows that start less than `span` before the end of their text do not fit
    inner = first[1:-1]
    np.add.at(fits, np.maximum(inner - span + 1, 0), 1)
    np.add.at(fits, inner, -1)
    # short texts overlap: starts before a text's own first word belong to the text before it
    at = np.flatnonzero(np.cumsum(fits)[:n] == 0)
    return mixed(total[at]), at


class TestSet:
    """Words of a block of test items and a sorted index of their seeds."""

    __test__ = False

    def __init__(self, ids: list, texts: list[str], masks: tuple[str, ...], least_item: int, similarity: float = 0.8, least: int = 13):
        self.ids = ids
        w = words(_fold(pa.array(texts, pa.string())), ALNUM)
        self.hash, self.first = w.hashes(), w.first
        self.size = np.diff(self.first)
        #: (mask, number, sorted keys, their places, their items, which leading bits occur) of long items and of runs of short ones
        self.seeds: list[tuple] = []
        for no, mask in enumerate(masks):
            k, at = seed_hashes(self.hash, self.first, mask, no)
            long = self.size[np.searchsorted(self.first, at, side="right") - 1] > least
            self._add(mask, no, k[long], at[long])
        runs: dict[int, list[int]] = {}  # length: places
        for i, n in enumerate(self.size.tolist()):
            if max(least_item, 1) <= n <= least:
                cuts = np.linspace(0, n, n - needed(n, similarity) + 2).astype(int)
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    runs.setdefault(int(y - x), []).append(int(self.first[i] + x))
        for n, places in sorted(runs.items()):
            k, at = seed_hashes(self.hash, self.first, "1" * n, len(masks))
            mine = np.isin(at, places)
            self._add("1" * n, len(masks), k[mine], at[mine])

    def _add(self, mask: str, no: int, key: np.ndarray, place: np.ndarray) -> None:
        if len(key):
            order = np.argsort(key, kind="stable")
            seen = np.zeros(1 << 22, bool)
            seen[key >> np.uint64(42)] = True
            self.seeds.append((mask, no, key[order], place[order], np.searchsorted(self.first, place[order], side="right") - 1, seen))


def needed(n: int, similarity: float) -> int:
    """How many of n tokens must be equal."""
    return math.ceil(similarity * n - 1e-9)


def stretch(same: np.ndarray, similarity: float) -> tuple[int, int, int]:
    """(length, start, equal) of the longest stretch of `same` with at least `similarity` true, that begins and ends true."""
    gain = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0 - similarity, -similarity))])
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0, 0
    low = np.minimum.accumulate(gain[at])  # a start at the first place where the sum is at most gain[end]
    starts = at[np.searchsorted(-low, -(gain[at + 1] + 1e-9), side="left")]
    size = at + 1 - starts
    best = int(np.argmax(size))
    a, b = int(starts[best]), int(at[best]) + 1
    return b - a, a, int(same[a:b].sum())


def diagonals(w: Words, h: np.ndarray, test: TestSet, run: int = 1 << 20) -> np.ndarray:
    """Rows (text, item, place in texts - place in items) with a common seed, sorted, each once; `run` hits are held at a time."""
    reach = len(h) + len(test.hash) + 1
    kept, waiting, held = np.zeros(0, np.int64), [], 0
    for mask, no, key, spot, item, seen in test.seeds:
        k, at = seed_hashes(h, w.first, mask, no)
        maybe = np.flatnonzero(seen[k >> np.uint64(42)])
        k, at = k[maybe], at[maybe]
        lo = np.searchsorted(key, k, side="left")
        many = np.searchsorted(key, k, side="right") - lo
        hit = np.flatnonzero(many)
        lo, many, at = lo[hit], many[hit], at[hit]
        to = np.cumsum(many)
        first = 0
        while first < len(at):
            end = max(first + 1, int(np.searchsorted(to, (to[first - 1] if first else 0) + run, side="right")))
            n = many[first:end]
            rep = np.repeat(np.arange(first, end), n)
            slot = lo[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
            code = (w.doc[at[rep]] * len(test.size) + item[slot]) * reach + (at[rep] - spot[slot] + len(test.hash))
            waiting.append(np.unique(code))
            held += len(waiting[-1])
            if held > 2 * run:
                kept = np.unique(np.concatenate([kept, *waiting]))
                waiting, held = [], 0
            first = end
    kept = np.unique(np.concatenate([kept, *waiting])) if waiting else kept
    pair, shift = kept // reach, kept % reach - len(test.hash)
    return np.stack([pair // len(test.size), pair % len(test.size), shift], axis=1) if len(kept) else np.zeros((0, 3), np.int64)


def _equal_counts(h: np.ndarray, test: TestSet, shift: np.ndarray, lo: np.ndarray, hi: np.ndarray, run: int = 1 << 21) -> np.ndarray:
    """How many tokens lo..hi of the items are equal to those `shift` away in the texts, `run` compared at a time."""
    size, out, a = hi - lo, np.zeros(len(lo), np.int64), 0
    to = np.cumsum(size)
    while a < len(lo):
        b = max(a + 1, int(np.searchsorted(to, (to[a - 1] if a else 0) + run, side="right")))
        n = size[a:b]
        start = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(lo[a:b] - start, n)
        same = np.concatenate([[0], np.cumsum(h[at + np.repeat(shift[a:b], n)] == test.hash[at])])
        out[a:b] = same[start + n] - same[start]
        a = b
    return out


def overlaps(w: Words, h: np.ndarray, test: TestSet, similarity: float, least: int) -> list[tuple]:
    """(text, item, place in text, place in item, length, equal): the best overlap of each text and item that met."""
    if not test.seeds or not len(h):
        return []
    met = diagonals(w, h, test)
    text, item, shift = met.T
    size = test.size[item]
    a, b = test.first[item], test.first[item + 1]
    lo, hi = np.maximum(a, w.first[text] - shift), np.minimum(b, w.first[text + 1] - shift)
    whole = hi - lo == size
    inside = np.flatnonzero((hi > lo) & (whole | (size > least)))
    text, item, shift, size, a, lo, hi, whole = (x[inside] for x in (text, item, shift, size, a, lo, hi, whole))
    equal = _equal_counts(h, test, shift, lo, hi)
    enough = np.ceil(similarity * size - 1e-9)
    # No stretch of a diagonal is longer than this.
    bound = np.where(size <= least, size, np.minimum(np.floor(equal / similarity + 1e-9), hi - lo).astype(np.int64))
    some = np.flatnonzero(np.where(size <= least, equal >= enough, (bound >= least) | (whole & (equal >= enough))))
    out: dict[tuple[int, int], tuple] = {}
    for j in some[np.lexsort((shift[some], -equal[some], -bound[some]))].tolist():
        t, i, s = int(text[j]), int(item[j]), int(shift[j])
        best = out.get((t, i))
        if best and (int(bound[j]), int(equal[j]), -s) <= best[2:5]:
            continue
        n, start, e = int(size[j]), 0, int(equal[j])
        if n > least:
            n, start, e = stretch(h[lo[j] + s : hi[j] + s] == test.hash[lo[j] : hi[j]], similarity)
            if n < least and whole[j] and equal[j] >= enough[j]:  # the whole item, unequal ends included
                n, start, e = int(size[j]), 0, int(equal[j])
            if n < least:
                continue
        got = (int(lo[j]) + start + s - int(w.first[t]), int(lo[j] - a[j]) + start, n, e, -s)
        if best is None or got[2:] > best[2:]:
            out[t, i] = got
    return [(t, i, *got[:4]) for (t, i), got in out.items()]


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, similarity: float = 0.8, least: int = 13, least_item: int = 1, block_windows: int = 1_000_000) -> DataFrame:
    """(id_col, item_col, doc_start, item_start, n_tokens, n_equal, similarity): a row for each document and item that overlap.

    An overlap is a stretch of `least` tokens (the whole item if it is shorter), of which `similarity` are equal in place.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{item_col}` {benchmark.schema[item_col].dataType.simpleString()}, doc_start long, item_start long, n_tokens long, n_equal long, similarity double"

    def against(block: list[tuple]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = TestSet([b[0] for b in block], [b[1] for b in block], masks, least_item, similarity, least)
            ids = pa.array(test.ids)
            for batch in batches:
                for part in pieces(batch, text_col):
                    w = words(_fold(part.column(text_col)), ALNUM)
                    rows = overlaps(w, w.hashes(), test, similarity, least)
                    if rows:
                        t, i, a, b, n, e = map(np.array, zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays([part.column(id_col).take(pa.array(t)), ids.take(pa.array(i)), pa.array(a), pa.array(b), pa.array(n), pa.array(e), pa.array(e / n)], names=[id_col, item_col, "doc_start", "item_start", "n_tokens", "n_equal", "similarity"])

        return run

    out = None
    for block in blocks(benchmark.select(item_col, item_text_col), block_windows):
        found = map_arrow(docs.select(id_col, text_col), against(block), schema)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def blocks(benchmark: DataFrame, block_windows: int) -> Iterator[list[tuple]]:
    """The test items in runs of about `block_windows` characters / 6 at most, read one partition at a time."""
    run, size = [], 0
    for item, text in benchmark.where(F.col(benchmark.columns[1]).isNotNull()).toLocalIterator():
        run.append((item, text))
        size += len(text) // 6 + 1
        if size >= block_windows:
            yield run
            run, size = [], 0
    if run:
        yield run


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of `docs` whose text overlaps no test item, all columns; tested in place, so no text is shuffled."""
    masks, similarity, least, least_item = options.get("masks", MASKS), options.get("similarity", 0.8), options.get("least", 13), options.get("least_item", 1)
    out = docs
    for block in blocks(benchmark.select("item_id", "text"), options.get("block_windows", 1_000_000)):

        def run(batches: Iterator[pa.RecordBatch], block: list[tuple] = block) -> Iterator[pa.RecordBatch]:
            test = TestSet([b[0] for b in block], [b[1] for b in block], masks, least_item, similarity, least)
            for batch in batches:
                for part in pieces(batch, text_col):
                    w = words(_fold(part.column(text_col)), ALNUM)
                    bad = {r[0] for r in overlaps(w, w.hashes(), test, similarity, least)}
                    yield part.take(pa.array([i for i in range(len(part)) if i not in bad], pa.int64())) if bad else part

        out = map_arrow(out, run, docs.schema)
    return out

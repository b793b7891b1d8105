"""Language identification by unigram pieces, summed over all segmentations.

A fixed public vocabulary gives the pieces; each language has a probability for each piece, fitted by EM on a bounded
sample of labelled rows. The probability of a word is the sum, over all ways to cut it into pieces, of the products of
their probabilities: a forward recursion, run for many words at a time (long words: one, in blocks of bytes, in time and
memory that follow their length). A text scores the sum of the logarithms over its
words; the language with the highest sum wins, ties by name.

Cases: null texts and texts without a letter are `und` with score 0; rows without a label or an id do not train but are
predicted; without any labelled row everything is `und`; repeated rows count each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.shared import map_arrow
from clausemill.llm.tokens import _BASE, _INVERSE, _MASK, ALNUM, mixed, pieces, powers, words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
_MARK = "▁".encode()
#: Words of more bytes are scored one by one, in blocks of so many.
LONG, BLOCK = 1024, 1 << 16


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The pieces that can stand in a lower-cased word: without control pieces, white space, capitals and ASCII marks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in every if p == p.lower() and "▁" not in p[1:] and all(ALNUM[b] for b in p.encode())} | {"▁"})


class Pieces:
    """An open-addressing table from the hash of a piece's bytes to its number."""

    def __init__(self, vocabulary: list[str]):
        self.bits = max(10, (4 * len(vocabulary) - 1).bit_length())
        #: Bytes of the longest piece.
        self.longest = max(len(p.encode()) for p in vocabulary)
        self.key, self.number = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        for i, p in enumerate(vocabulary):
            h = _hash(p.encode())
            at = h >> (64 - self.bits)
            while self.key[at]:
                at = (at + 1) % len(self.key)
            self.key[at], self.number[at] = h, i

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        at, todo = (h >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(todo):
            key = self.key[at]
            hit = key == h[todo]
            out[todo[hit]] = self.number[at[hit]]
            more = ~hit & (key != 0)
            todo, at = todo[more], (at[more] + 1) & (len(self.key) - 1)
        return out


def _hash(raw: bytes) -> int:
    h = sum((c + 1) * pow(_BASE, i, 1 << 64) for i, c in enumerate(raw)) & _MASK
    return int(mixed(np.array([h], np.uint64))[0])


class Lattice:
    """All pieces that end at each byte of each of some words, every word led by the mark of a word's start."""

    def __init__(self, spelled: list[bytes], table: Pieces):
        longest = self.longest = table.longest
        self.size = np.array([len(s) + len(_MARK) for s in spelled], np.int64)
        data = np.frombuffer(b"".join(x for s in spelled for x in (_MARK, s)), np.uint8)
        n = len(data)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
        back = powers(_INVERSE, n + 1)
        into = np.arange(n) - np.repeat(self.start, self.size) + 1  # bytes of the word up to and with this one
        self.piece = np.full((longest + 1, n), -1, np.int32)
        for size in range(1, longest + 1):
            end = np.flatnonzero(into >= size) + 1
            self.piece[size, end - 1] = table.find(mixed((sums[end] - sums[end - size]) * back[end - size]))
        head = (data & 0xC0) != 0x80
        self.char_end = np.concatenate([head[1:], [True]]) if n else head  # a character ends here
        self.char_size = np.zeros(n, np.int64)
        if n:
            ends = np.flatnonzero(self.char_end)
            self.char_size[ends] = np.diff(np.concatenate([[-1], ends]))


def forward(lattice: Lattice, p: np.ndarray, unknown: float) -> np.ndarray:
    """log of each word's probability, (words, languages); p: (pieces, languages). Any character may also stand alone, at `unknown`."""
    n, langs, longest = len(lattice.size), p.shape[1], lattice.longest
    logs = np.zeros((n, langs))
    order = np.argsort(lattice.size, kind="stable")
    for group in np.array_split(order, max(1, n // 20_000 + 1)):
        if not len(group):
            continue
        size, start = lattice.size[group], lattice.start[group]
        ring = np.zeros((longest + 1, len(group), langs))
        ring[0] = 1.0
        scale = np.zeros((len(group), langs))
        for t in range(1, int(size[-1]) + 1):
            alive = int(np.searchsorted(size, t))
            at = start[alive:] + t - 1
            now = np.zeros((len(group) - alive, langs))
            for k in range(1, min(t, longest) + 1):
                number = lattice.piece[k, at]
                has = np.flatnonzero(number >= 0)
                if len(has):
                    now[has] += ring[(t - k) % (longest + 1), alive + has] * p[number[has]]
            bare = np.flatnonzero(lattice.char_end[at])
            if len(bare):
                step = lattice.char_size[at[bare]]
                now[bare] += ring[(t - step) % (longest + 1), alive + bare] * unknown
            ring[t % (longest + 1), alive:] = now
            if t % 8 == 0:
                top = ring[:, alive:].max(axis=0)
                top[top <= 0] = 1.0
                ring[:, alive:] /= top
                scale[alive:] += np.log(top)
            done = np.searchsorted(size, t, side="right")
            if done > alive:
                logs[group[alive:done]] = np.log(ring[t % (longest + 1), alive:done] + 1e-300) + scale[alive:done]
    return logs


def forward_long(word: bytes, table: Pieces, p: np.ndarray, unknown: float, block: int = BLOCK) -> np.ndarray:
    """The same of one long word, from its bytes: block by block, with the sums of the last bytes carried on."""
    data = _MARK + word
    longest, langs = table.longest, range(p.shape[1])
    size = longest + 1
    ring = [[0.0] * size for _ in langs]
    for r in ring:
        r[0] = 1.0
    scale = np.zeros(p.shape[1])
    rows = p.T.tolist()
    last_char = -1  # place of the byte before the character that is being read
    for a in range(0, len(data), block):
        low, b = max(0, a - longest), min(len(data), a + block)
        part = np.frombuffer(data[low:b], np.uint8)
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
        back = powers(_INVERSE, n + 1)
        ends, sizes, numbers = [], [], []
        for k in range(1, longest + 1):
            end = np.arange(max(k, a - low + 1), n + 1)
            found = table.find(mixed((sums[end] - sums[end - k]) * back[end - k]))
            has = np.flatnonzero(found >= 0)
            ends.append(end[has])
            sizes.append(np.full(len(has), k))
            numbers.append(found[has])
        end, k_of, number = map(np.concatenate, (ends, sizes, numbers))
        order = np.argsort(end, kind="stable")
        first = np.searchsorted(end[order], np.arange(a - low + 1, n + 2)).tolist()
        k_of, number = k_of[order].tolist(), number[order].tolist()
        closes = [t + 1 == len(data) or (data[t + 1] & 0xC0) != 0x80 for t in range(a, b)]
        for i, t in enumerate(range(a + 1, b + 1)):
            arcs = range(first[i], first[i + 1])
            alone = t - 1 - last_char if closes[i] else 0
            if alone:
                last_char = t - 1
            for x in langs:
                r, row = ring[x], rows[x]
                total = unknown * r[(t - alone) % size] if alone else 0.0
                for j in arcs:
                    total += r[(t - k_of[j]) % size] * row[number[j]]
                r[t % size] = total
            if t % 8 == 0:
                for x in langs:
                    top = max(ring[x])
                    if top > 0:
                        ring[x] = [v / top for v in ring[x]]
                        scale[x] += math.log(top)
    return np.log(np.array([r[len(data) % size] for r in ring]) + 1e-300) + scale


def fit(counts: dict[str, int], table: Pieces, n_pieces: int, unknown: float, rounds: int, group: int = 2048) -> np.ndarray:
    """Piece probabilities of one language by EM over its words and their counts; a small part goes to unseen pieces.

    Words are taken in groups of like size, so that no more than a group's lattice is in memory.
    """
    spelled = sorted(((w.encode(), n) for w, n in counts.items()), key=lambda x: (len(x[0]), x[0]))
    groups = [spelled[a : a + group] for a in range(0, len(spelled), group)]
    start = np.zeros(n_pieces)
    for words_ in groups:
        lattice = Lattice([w for w, _ in words_], table)
        flat = np.repeat(np.array([n for _, n in words_], float), lattice.size)
        for k in range(1, lattice.longest + 1):
            has = lattice.piece[k] >= 0
            np.add.at(start, lattice.piece[k, has], flat[has] * k)
    p = _smooth(start)
    for _ in range(rounds):
        fresh = np.zeros(n_pieces)
        for words_ in groups:
            _expect(Lattice([w for w, _ in words_], table), np.array([n for _, n in words_], float), p, unknown, fresh)
        p = _smooth(fresh)
    return p


def _expect(lattice: Lattice, weight: np.ndarray, p: np.ndarray, unknown: float, fresh: np.ndarray) -> None:
    """Adds to `fresh` how often each piece is expected in the words, of which there are `weight`."""
    size, number, longest, at = lattice.size, lattice.piece, int(lattice.size.max(initial=0)), lattice.start
    rows = np.arange(len(size))
    alpha = np.zeros((len(size), longest + 1))
    alpha[:, 0] = 1.0
    boost = 64.0  # keeps products of small probabilities in range: a factor for each byte, the same for all segmentations
    arcs: list[list[tuple]] = [[] for _ in range(longest + 1)]
    bare: list[tuple] = [()] * (longest + 1)
    for t in range(1, longest + 1):
        here = rows[size >= t]
        end = at[here] + t - 1
        for k in range(1, min(t, lattice.longest) + 1):
            ids = number[k, end]
            some = ids >= 0
            if some.any():
                has, ids = here[some], ids[some]
                arcs[t].append((k, has, ids))
                alpha[has, t] += alpha[has, t - k] * p[ids] * boost**k
        closes = lattice.char_end[end]
        ends, c = here[closes], lattice.char_size[end[closes]]
        bare[t] = (ends, c)
        alpha[ends, t] += alpha[ends, t - c] * unknown * boost**c
    total = alpha[rows, size]
    beta = np.zeros_like(alpha)
    beta[rows, size] = np.where(total > 0, weight / np.where(total > 0, total, 1), 0)
    for t in range(longest, 0, -1):
        for k, has, ids in arcs[t]:
            flow = p[ids] * boost**k * beta[has, t]
            np.add.at(fresh, ids, alpha[has, t - k] * flow)
            beta[has, t - k] += flow
        ends, c = bare[t]
        beta[ends, t - c] += unknown * boost**c * beta[ends, t]


def _smooth(counts: np.ndarray, part: float = 0.05) -> np.ndarray:
    total = counts.sum()
    return (1 - part) * counts / (total or 1.0) + part / len(counts)


class Model:
    def __init__(self, languages: list[str], vocabulary: list[str], p: np.ndarray, unknown: float):
        self.languages, self.vocabulary, self.p, self.unknown = languages, vocabulary, p, unknown


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 600, sample_words: int = 60_000, rounds: int = 4, unknown: float = 1e-7, path: str = VOCABULARY) -> Model:
    """Fit on at most `sample_rows` rows of each language, those of the smallest hash of the id, and of these on the
    `sample_words` most frequent words. Rows held out, unlabelled or without an id are not used."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    order = Window.partitionBy("_lang").orderBy("_order", "_id")
    narrow = usable.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.xxhash64(F.col(id_col).cast("string")).alias("_order"))
    # Hashes are even: of n rows about 4 * sample_rows are under this bound, so that no task sorts a language. Sizes have
    # a row for each language, of which the model holds a column each on the driver.
    sizes = narrow.groupBy("_lang").agg(F.count(F.lit(1)).alias("_rows"))
    bound = F.col("_order") / F.lit(2.0**64) + 0.5 <= 4.0 * sample_rows / F.col("_rows")
    narrow = narrow.join(F.broadcast(sizes), "_lang").where(bound)
    chosen = narrow.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample_rows).select("_id", "_lang").distinct()
    sample = usable.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("text")).join(F.broadcast(chosen), ["_id", "_lang"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, str], int] = {}
            for part in pieces(batch):
                w = words(pc.utf8_lower(part.column("text")), ALNUM)
                _, first, many = np.unique(w.hashes() + w.doc.astype(np.uint64), return_index=True, return_counts=True)
                lang = part.column("_lang").to_pylist()
                for i, n in zip(first, many, strict=True):
                    if w.ends[i] - w.starts[i] <= 64:  # longer ones would set the width of the tables of EM
                        key = (lang[w.doc[i]], w.text(i).decode("utf-8", "replace"))
                        seen[key] = seen.get(key, 0) + int(n)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    counted = map_arrow(sample.select("_lang", "text"), count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    best = counted.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("at") <= sample_words)
    by: dict[str, dict[str, int]] = {}
    for lang, word, n in best.select("lang", "word", "n").collect():  # sample_words rows a language at most
        by.setdefault(lang, {})[word] = n
    pieces_ = vocabulary(path)
    table = Pieces(pieces_)
    languages = sorted(by)
    p = np.stack([fit(dict(sorted(by[x].items())), table, len(pieces_), unknown, rounds) for x in languages], axis=1) if languages else np.zeros((len(pieces_), 0))
    return Model(languages, pieces_, p, unknown)


class Scorer:
    """Log probabilities of texts; words met before are remembered, `most` of them."""

    def __init__(self, model: Model, most: int = 250_000):
        self.model, self.table, self.most = model, Pieces(model.vocabulary), most
        self.key, self.value = np.zeros(0, np.uint64), np.zeros((0, len(model.languages)))

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) sums, and which texts have a letter."""
        lowered = pc.utf8_lower(column.fill_null("") if column.null_count else column)
        w = words(lowered, ALNUM)
        sums = np.zeros((len(column), len(self.model.languages)))
        letters = np.zeros(len(column), bool)
        if len(w):
            ascii_letter = np.concatenate([[0], np.cumsum((w.data >= 0x61) & (w.data <= 0x7A))])
            letters = ascii_letter[w.offsets[1:]] > ascii_letter[w.offsets[:-1]]
            for i in np.flatnonzero(~letters & (w.counts() > 0)):
                letters[i] = any(c.isalpha() for c in lowered[int(i)].as_py())
            key, first, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
            value = self.values(w, key, first)
            for j in range(value.shape[1]):
                sums[:, j] = np.bincount(w.doc, weights=value[inverse, j], minlength=len(column))
        return sums, letters

    def values(self, w, key: np.ndarray, first: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.key, key)
        known = np.zeros(len(key), bool)
        known[at < len(self.key)] = self.key[at[at < len(self.key)]] == key[at < len(self.key)]
        out = np.empty((len(key), len(self.model.languages)))
        out[known] = self.value[at[known]]
        new = np.flatnonzero(~known)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            long = (w.ends - w.starts)[first[part]] > LONG
            if not long.all():
                out[part[~long]] = forward(Lattice([w.text(k) for k in first[part[~long]]], self.table), self.model.p, self.model.unknown)
            for k in part[long]:
                out[k] = forward_long(w.text(first[k]), self.table, self.model.p, self.model.unknown)
        if len(new):
            if len(self.key) + len(new) > self.most:
                self.key, self.value = key, out
            else:
                order = np.argsort(every := np.concatenate([self.key, key[new]]))
                self.key, self.value = every[order], np.concatenate([self.value, out[new]])[order]
        return out


def _judge(scorer: Scorer, column: pa.Array) -> tuple[list[str], np.ndarray]:
    names = scorer.model.languages
    if not names:
        return ["und"] * len(column), np.zeros(len(column))
    sums, letters = scorer.texts(column)
    best = sums.argmax(axis=1)
    score = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    return [names[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score), a row for each row of docs; score is the posterior probability of lang_pred."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in pieces(batch, text_col, 1_000_000):
                lang, score = _judge(scorer, part.column(text_col))
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(lang, pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"])

    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns, with a language of the model whose posterior is `least` or more; judged in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in pieces(batch, text_col, 1_000_000):
                lang, score = _judge(scorer, part.column(text_col))
                yield part.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score, strict=True)]))

    return map_arrow(docs, run, docs.schema)

"""Near copies of the pipeline against all pairs of sets."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import LOWER, SPACE_WORD, components
from pyspark.sql import functions as F

import corpus_pipeline
from clausemill.llm import nearcopies, simhash

SF = "/root/testdata/sf0.01"


def grams(text, size=5):
    w = SPACE_WORD.findall((text or "").translate(LOWER))
    return frozenset(" ".join(w[i : i + size]) for i in range(len(w) - size + 1)) or frozenset([" ".join(w)])


def kept(rows):
    sets = {i: grams(t) for i, t in rows}
    alike = lambda x, y: 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and not (len(x) > 40 and x.isdisjoint(y)) and 5 * len(x & y) >= 4 * len(x | y)
    linked = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if alike(sets[a], sets[b])]
    return set(components(sorted(sets), linked).values())


def near(rng, words, part):
    return " ".join("".join(rng.choices("abcdefgh", k=6)) if rng.random() < part else w for w in words)


def test_all_near_copies_of_documents_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert {r["doc_id"] for r in one.collect()} == kept([(r["doc_id"], r["text"]) for r in docs.collect()]) and one.columns == docs.columns


@pytest.mark.parametrize("crowded", [2, 64])
def test_borders_and_short_texts(spark, crowded):
    rng = random.Random(9)
    texts = ["", None, " \n", "one", "ONE", "one two three four", "one two three four five"]
    for n in (5, 8, 9, 12, 30, 60, 200):
        base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
        texts += [" ".join(base), " ".join(base[1:]), " ".join(base[: n - n // 5]), *[near(rng, base, x) for x in (0.01, 0.02, 0.02, 0.03, 0.05)]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in nearcopies.keep_one(df, crowded=crowded).collect()} == kept(rows)


def test_rows_that_share_an_id(spark):
    rows = [(1, "same text here"), (1, "same text here"), (1, "SAME text here"), (2, "same text here"), (2, "of its own"), (None, "no id"), (None, "no id"), (None, "of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted(((r["doc_id"], r["text"].lower()) for r in nearcopies.keep_one(df).collect()), key=str)
    assert got == [(1, "same text here"), (2, "of its own"), (None, "no id")]


@pytest.mark.parametrize("crowded", [4, 64])
def test_crowded_groups_connect_what_is_near(spark, crowded):
    """Groups of near copies of one text each, that all share a line; chains of copies of copies."""
    rng = random.Random(3)
    line = "this common line stands in all texts of this test without any change"
    texts = []
    for g in range(5):
        base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(rng.choice([30, 150]))]
        texts += [f"{near(rng, base, x)} {line}" for x in [0.0] + [0.02] * 25]
        for _ in range(12):  # each a copy of the last
            base = near(rng, base, 0.015).split()
            texts.append(f"{' '.join(base)} {line}")
    texts += [f"{' '.join(rng.choices('abcdefghij', k=9))} {line}" for _ in range(40)] + [line] * 3
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = kept(rows)
    assert {r["doc_id"] for r in nearcopies.keep_one(df, crowded=crowded).collect()} == want and 10 < len(want) < 150


def test_groups_connect_what_is_near():
    rng = random.Random(3)
    texts = []
    for _ in range(4):
        base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(150)]
        texts += [near(rng, base, x) for x in [0.0] + [0.02] * 25]
    rng.shuffle(texts)
    sets = [s.view(np.int64) for s in nearcopies.shingles_of(pa.array(texts))]
    prints = np.stack([nearcopies.fingerprint(s.view(np.uint64)) for s in sets]).view(np.int64)
    want = components(range(len(texts)), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))])
    assert components(range(len(texts)), nearcopies.group_links(np.arange(len(texts)), prints, sets, 0.8)) == want


def test_golay_keys_of_fingerprints_link_near_copies(spark):
    """Without keys of the exact way: most near copies are linked by SimHash, and nothing that is not similar."""
    rng = random.Random(7)
    texts = []
    for n in (60, 200, 400):
        for _ in range(4):
            base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
            texts += [" ".join(base), *[near(rng, base, x) for x in (0.005, 0.01, 0.015, 0.05)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sketches = nearcopies._sketches(df, "doc_id", "text", 5, 0.8)
    node = {r["id"]: r["node"] for r in sketches.collect()}
    sets = {node[i]: grams(t) for i, t in enumerate(texts)}
    similar = {frozenset((a, b)) for a, b in itertools.combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    links = lambda s: [(r["u"], r["v"]) for r in nearcopies.links(df, s, "text", 5, 0.8, 64).collect()]
    want = components(sorted(sets), [tuple(p) for p in similar])
    got = components(sorted(sets), links(sketches.withColumn("keys", F.array().cast("array<long>"))))
    assert all(want[a] == want[b] for a, b in got.items())
    joined = len(sets) - len(set(want.values()))
    assert joined >= 15 and len(sets) - len(set(got.values())) >= 0.8 * joined
    assert components(sorted(sets), links(sketches)) == want


def test_golay_pairs_are_a_star_for_each_key(spark):
    """A group of equal fingerprints makes a row for each member, not one for each pair."""
    prints = spark.createDataFrame([(i, 5, 6, 7, 8) for i in range(300)], "node long, f0 long, f1 long, f2 long, f3 long")
    assert sorted((r["u"], r["v"]) for r in nearcopies.golay_pairs(prints).collect()) == [(0, i) for i in range(1, 300)]


def test_wide_keys_meet_at_errors_in_one_segment():
    rng = random.Random(8)
    for _ in range(50):
        x = [rng.getrandbits(64) for _ in range(4)]
        w, at = rng.randrange(4), 16 * rng.randrange(4)
        y = [v ^ rng.getrandbits(64) for v in x]  # all else differs
        same = sum(1 << (at + i) % 64 for i in range(39))
        y[w] = (y[w] & ~same) | (x[w] & same)
        for i in rng.sample(range(16, 39), 2):
            y[w] ^= 1 << (at + i) % 64
        place, key = simhash.wide_keys(np.array([x, y], np.uint64))
        assert set(key[place == 0].tolist()) & set(key[place == 1].tolist())


def test_sets_of_one_part_are_not_linked_again():
    texts = [" ".join(f"w{i}" for i in range(100) if i != gap) for gap in range(95, 100)]
    sets = [s.view(np.int64) for s in nearcopies.shingles_of(pa.array(texts))]
    prints = np.stack([nearcopies.fingerprint(s.view(np.uint64)) for s in sets]).view(np.int64)
    part = np.array([7, 7, 7, -1, -1])
    assert len(nearcopies.group_links(np.arange(5), prints, sets, 0.8, part)) == 1
    assert nearcopies.has_near(prints, np.array([len(s) for s in sets]), 0.8, part).all()
    assert not nearcopies.has_near(prints, np.array([len(s) for s in sets]), 0.8, np.zeros(5, np.int64)).any()


def test_common_lines_are_no_crowded_keys(spark, monkeypatch):
    """Texts that share a line, and no more, do not all meet in its keys; near copies among them are found all the same."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    line = [word() for _ in range(40)]
    texts = [[word() for _ in range(rng.randint(20, 50))] + line + [word() for _ in range(rng.randint(5, 20))] for _ in range(480)]
    texts += [near(rng, t, 0.025).split() for t in texts[::8]] + [line, line[1:], line[:-2]]
    rows = list(enumerate(map(" ".join, texts)))
    tables, saved = {}, nearcopies.saved
    monkeypatch.setattr(nearcopies, "saved", lambda df, name: tables.setdefault(name, saved(df, name)))
    found = nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    crowds = tables["near-sketches"].select(F.explode("keys").alias("key")).groupBy("key").count()
    assert crowds.agg(F.max("count")).collect()[0][0] < 64
    assert {r["doc_id"] for r in found.collect()} == kept(rows)


def test_fingerprints_at_once_are_those_of_each():
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)) for n in (0, 1, 2, 254, 255, 256, 510, 511, 0, 3000, 7)]
    assert np.array_equal(nearcopies.fingerprints(sets), np.stack([nearcopies.fingerprint(s) for s in sets]))
    assert nearcopies.fingerprints([]).shape == (0, 4) and not nearcopies.fingerprints(sets[:1]).any()

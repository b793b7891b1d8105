"""Whole short items with substituted words, and the longest stretch, against all places."""

import itertools
import random

import numpy as np

from clausemill.llm import decontam


def test_items_of_up_to_13_tokens_with_every_substitution(spark):
    rows, items, want = [], [], set()
    for n in range(1, 15):
        item = [f"w{n}x{j}" for j in range(n)]
        items.append((n, " ".join(item)))
        for m in range(3):
            for bad in itertools.combinations(range(n), m):
                rows.append((len(rows), "before " + " ".join("zzz" if j in bad else x for j, x in enumerate(item)) + " after"))
                if 5 * (n - m) >= 4 * n:
                    want.add((rows[-1][0], n, 1, 0, n, n - m) if n < 14 else (rows[-1][0], n))
    rows.append((len(rows), " ".join(items[7][1].split()[:7])))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["doc_start"], r["item_start"], r["n_tokens"], r["n_equal"]) if r["item_id"] < 14 else (r["doc_id"], r["item_id"]) for r in decontam.find(df, bench).collect()}
    assert found == want
    assert {x[1] for x in want} == set(range(1, 15))
    assert {r["doc_id"] for r in decontam.find(df, bench, least_item=5).collect()} == {x[0] for x in want if x[1] >= 5}
    assert {r["doc_id"] for r in decontam.clean(df, bench, least_item=5).collect()} == {i for i, _ in rows} - {x[0] for x in want if x[1] >= 5}


def test_longest_stretch_begins_and_ends_equal():
    rng = random.Random(2)
    runs = [[True] * 12 + [False] * 3 + [True] * 14, [False] * 5, [True]]
    for same in runs + [[rng.random() < 0.7 for _ in range(rng.randint(1, 40))] for _ in range(300)]:
        best = max((b - a for a in range(len(same)) for b in range(a + 1, len(same) + 1) if same[a] and same[b - 1] and 5 * sum(same[a:b]) >= 4 * (b - a)), default=0)
        size, start, equal = decontam.stretch(np.array(same), 0.8)
        assert size == best and equal == sum(same[start : start + size]) and 5 * equal >= 4 * size

"""The pipeline against its stages in plain Python, and the SQL counterparts of the operators."""

import collections
import functools
import hashlib
import re

import duckdb
import numpy as np
import pytest
from brute import LICENCE_WORD, decontaminated, secret_base
from test_nearcopies import kept

import corpus_pipeline
from clausemill.llm import langid, packing, queries, secrets

SF = "/root/testdata/sf0.001"


def language(model, text):
    """(language, posterior) by a plain sum over all segmentations of each word; None without a letter."""
    text = (text or "").lower()
    if not any(c.isalpha() for c in text):
        return None, 0.0
    number = {p: i for i, p in enumerate(model.vocabulary)}
    longest = max(map(len, number))

    @functools.cache
    def log(word):
        sums = [np.ones(len(model.languages))]
        for t in range(1, len(word) + 1):
            total = sums[t - 1] * model.unknown
            for k in range(1, min(t, longest) + 1):
                if word[t - k : t] in number:
                    total = total + sums[t - k] * model.p[number[word[t - k : t]]]
            sums.append(total)
        return np.log(sums[-1])

    total = sum(log("▁" + w) for w in LICENCE_WORD.findall(text))
    best = int(np.argmax(total))
    return model.languages[best], 1 / np.exp(total - total[best]).sum()


def redacted(text):
    """Every secret by its kind in brackets, overlapping ones by that of the first."""
    found = []
    for no, r in enumerate(secrets.RULES):
        found += [(m.start(), no, m.end(), r.kind) for m in re.finditer(re.sub(r"\(\?:\(\?i\)(.*?\))\)", r"(?i:\1)", r.find), text, re.A) if len(m[r.group]) >= r.least]
    out, to = "", 0
    for start, _, end, kind in sorted(found):
        if start >= to:
            out += text[to:start] + f"[{kind}]"
        to = max(to, end)
    return out + text[to:]


def packed(rows, max_len=2048, buckets=8, budget=65536):
    """(doc, piece, first, n, bucket, bucket length, batch, slot, ids) of all pieces of the texts."""
    pieces, ids = [], {}
    with open(packing.VOCABULARY, "rb") as f:
        tokens = packing.encoder(f.read())
    for i, text in rows:
        ids[i] = tokens.encode_ordinary(text)
        n = len(ids[i])
        pieces += [(i, k, k * max_len, min(max_len, n - k * max_len)) for k in range(max(1, -(-n // max_len)))]
    many = sorted(collections.Counter(p[3] for p in pieces).items())
    ends = packing.boundaries([n for n, _ in many], [m for _, m in many], buckets)
    by = {}
    for p in pieces:
        by.setdefault(next(k for k, e in enumerate(ends) if p[3] <= e), []).append(p)
    out = []
    for k, some in by.items():
        room = max(1, budget // max(1, ends[k]))
        some.sort(key=lambda p: (hashlib.md5(f"{p[0]}:{p[1]}".encode()).hexdigest(), p[3]))
        out += [(*p, k, ends[k], at // room, at % room, ids[p[0]][p[2] : p[2] + p[3]]) for at, p in enumerate(some)]
    return sorted(out)


def test_every_stage_and_the_whole_run_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "secret_redaction", "packing"]
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    model = langid.train(docs)
    judged = {i: language(model, t) for i, t in rows.items()}
    one = {i for i, (lang, score) in judged.items() if lang and score >= 0.5}
    kept_ = corpus_pipeline.identify_language(spark, docs, SF)
    assert kept_.columns == docs.columns and ids(kept_) == one
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()}
    assert all(found[i][0] == (lang or "und") and abs(found[i][1] - score) < 1e-6 for i, (lang, score) in judged.items())

    near = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert near.columns == docs.columns and ids(near) == kept(list(rows.items()))
    leaks = {x[0] for x in decontaminated(list(rows.items()), items)}
    clean = corpus_pipeline.drop_leaks(spark, docs, SF)
    assert clean.columns == docs.columns and ids(clean) == set(rows) - leaks and leaks
    red = corpus_pipeline.redact_secrets(spark, docs, SF)
    assert red.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in red.collect()} == {i: (redacted(t), len(redacted(t))) for i, t in rows.items()}
    assert any(secret_base(t) for t in rows.values())

    left = [(i, t) for i, t in rows.items() if i in one]
    left = [(i, t) for i, t in left if i in kept(left)]
    left = [(i, redacted(t)) for i, t in left if i not in leaks]
    out = corpus_pipeline.run(spark, SF)
    columns = ["doc_id", "piece", "first_token", "n_tokens", "bucket", "bucket_len", "batch", "slot", "token_ids"]
    assert sorted(map(tuple, out.select(columns).collect())) == packed(left)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    bag = lambda cols, data: collections.Counter(tuple(r[cols.index(c)] for c in sorted(cols)) for r in data)
    assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag(names, result.fetchall())

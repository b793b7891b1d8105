"""Neighbours of pages among copies."""

import random

import pytest

from clausemill.llm import pagediff


@pytest.mark.parametrize("parts", [1, 3, 8, 40])
def test_copies_in_a_row_are_differenced_alike(spark, parts):
    page = lambda own: f"<body><div>Site name</div><div>Menu</div><div>{own}</div><div>All about us</div></body>"
    rng = random.Random(parts)
    texts = [f"Text {k}" for k in range(9) for _ in range(rng.choice([1, 3, 4, 7]))]
    rows = [(i, f"http://h/a/{i:03d}", page(t)) for i, t in enumerate(texts)]
    rows += [(1000 + i, f"http://one/{i}", page("Same")) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r["page_id"]: r["text"] for r in pagediff.extract(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert got == dict(enumerate(texts)) | {1000 + i: "Site name Menu Same All about us" for i in range(5)}


def test_given_pages_against_a_plain_search_for_neighbours(spark):
    """Neighbours by a walk over all pages in order; near copies, parts and long pages included."""
    import numpy as np
    import xxhash
    import zstandard

    rng = random.Random(4)
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    prose = [" ".join(rng.choices("abcdefg", k=rng.choice([3, 25, 60]))) for _ in range(12)]
    for i in range(120):
        body = "".join(f"<{t}>{rng.choice(prose)}</{t}>" for t in rng.choices(["p", "div", "li", "h2"], k=rng.randint(0, 9)))
        rows.append((1000 + i, f"http://h{rng.randint(0, 2)}/{rng.choice('ab')}/{rng.randint(0, 40)}", rng.choice(["<article>{}</article>", "<main>{}</main>", "{}", "<div>{}</div>", "<div class=legal>{}</div>"]).format(body) + "<div>Same end</div>"))
    rows.append((5000, "http://h1/long", "<p>" + "<p>".join(rng.choices(prose, k=20_000))))
    rows += rows[-3:-1]

    pages = []
    for i, url, page in rows:
        found = pagediff.blocks(page)
        mine = pagediff.body_of([b[:2] for b in found])
        text = "\n".join(t for (_, t, _), m in zip(found, mine, strict=True) if m)
        hashes = np.array([xxhash.xxh64_intdigest(t) for _, t, _ in found], np.uint64).tobytes()
        flags = bytes(pagediff.BODY * m + pagediff.SAFE * (r == pagediff.ARTICLE) for (r, _, _), m in zip(found, mine, strict=True))
        parts = np.array([c for (_, _, c), m in zip(found, mine, strict=True) if m], np.int32).tobytes()
        pages.append((*pagediff.place(url), xxhash.xxh64_intdigest(text) >> 1, hashes, flags, parts, zstandard.ZstdCompressor().compress(text.encode()), i))
    every = sorted({p[:3]: min(q[3] for q in pages if q[:3] == p[:3]) for p in pages}.items())
    want = []
    for host, path, sign, hashes, flags, parts, body, i in pages:
        at = [k for k, _ in every].index((host, path, sign))
        sides = []
        for walk in (every[:at][::-1], every[at + 1 :]):
            other = next(((k, h) for k, h in walk if k[2] != sign), None)
            sides.append({"host": other[0][0], "path": other[0][1], "hashes": other[1]} if other else None)
        want.append((i, pagediff.main_text(host, path, hashes, flags, parts, body, *sides)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert sorted((r["page_id"], r["text"]) for r in pagediff.extract(df).collect()) == sorted(want)

"""Operators over DataFrames: all physical forms agree, whatever the chunks."""

import random

import numpy as np
import pyarrow as pa
import pytest

from clausemill.batch import Scanner, Texts
from clausemill.config import LanguageConfig
from clausemill.kernel import Rules
from clausemill.operators import segment
from clausemill.plans import catalyst
from clausemill.queries import CUSTOM

TOKENS = ["Dr", " U.S", "...", "…", ".", "!", "?", "!?", " ", "  ", "\n", "(", ")", "[", "]", "'", '"', "a", "b", "The", "he ", "um...", "uh... so", "5", "3.5", "é", "😀", "°", "'s ", "s' ", "Ph.D.", " Inc. ", "it. No. ", "You", "Therefore ", "えーと…", "。", "「", "」", "！？", "①", "İ", "1)", "(12)", "6'", '12"', "　", ";", ";;", "|", "<", ">", "bzw", ".."]


@pytest.fixture(scope="module")
def soup(spark):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice(TOKENS) for _ in range(rng.randint(0, 60)))) for i in range(600)] + [(600, None), (601, "  \n ")]
    df = spark.createDataFrame(rows, "id long, text string").cache()
    df.count()
    return df


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("language", ["en", "ja", "custom"])
def test_forms_agree(soup, language):
    rules = LanguageConfig.from_text(CUSTOM) if language == "custom" else language
    slices = ("id", "idx", "text", "start", "end")
    arrow = segment.sentences(soup, ["id"], rules)
    assert rows(arrow, *slices) == rows(catalyst.sentences(soup, ["id"], rules), *slices)
    every = (*slices, "start_byte", "end_byte")
    assert rows(arrow, *every) == rows(segment.giant_sentences(soup, ["id"], rules, size=17), *every)
    cuts = ("id", "char_offset", "offset")
    assert rows(segment.boundaries(soup, ["id"], rules), *cuts) == rows(segment.chunked_boundaries(soup, ["id"], rules, size=13), *cuts) == rows(catalyst.boundaries(soup, ["id"], rules), *cuts)


def test_giant_texts_take_the_chunked_way(spark):
    df = spark.createDataFrame([(1, "(a. b) c. " * 500), (2, "Hi. You")], "id long, text string")
    want = rows(segment.sentences(df, ["id"], giant=None), "id", "idx", "text", "start", "end")
    assert rows(segment.sentences(df, ["id"], giant=1000), "id", "idx", "text", "start", "end") == want


def test_null_blank_and_stats(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "Hé. Ho")], "id long, text string")
    assert rows(segment.sentences(df, ["id"]), "id", "text") == [(4, "Ho"), (4, "Hé.")]
    assert rows(segment.stats(df, ["id"]), "id", "bytes_processed", "chars_processed", "sentence_count", "avg_sentence_length") == [(1, 0, 0, 0, 0.0), (2, 0, 0, 0, 0.0), (3, 2, 2, 0, 0.0), (4, 7, 6, 1, 6.0)]
    found = {r["id"]: r["sentences"] for r in segment.sentence_arrays(df).collect()}
    assert found[1] is None and found[2] == [] and [x["text"] for x in found[4]] == ["Hé.", "Ho"]


def test_no_shuffle_and_only_needed_columns(spark, monkeypatch):
    monkeypatch.setattr("clausemill.ship.WAVE_BYTES", 0)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = segment.sentences(df, ["doc_id"], giant=None)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "source" not in plan.partition("ReadSchema")[2]


REPEATED = [(1, "Good morning. We went out! It was (cold. very) late."), (1, "Hello there. Bye."), (1, "Hello there. Bye."), (2, None), (2, ""), (2, "   "), (None, "One. Two! \n \n Three"), (3, "A  .   . B. " * 50)]


def test_rows_that_share_their_keys(spark):
    """In every form each row is a text of its own."""
    df = spark.createDataFrame(REPEATED, "id long, text string").repartition(3)
    rules = Rules.of("en")
    cut = lambda t: [(i, x, s, e) for i, (s, e, x) in enumerate(rules.slices(t or ""))]
    want = sorted(((k, *row) for k, t in REPEATED for row in cut(t)), key=str)
    columns = ["id", "idx", "text", "start", "end"]
    for got in (segment.sentences(df, ["id"]), segment.giant_sentences(df, ["id"], size=7), segment.sentences(df, ["id"], giant=20), catalyst.sentences(df, ["id"])):
        assert sorted(map(tuple, got.select(columns).collect()), key=str) == want
    ends = sorted(((k, at) for k, t in REPEATED for at in rules.boundaries(t or "")), key=str)
    for got in (segment.boundaries(df, ["id"]), segment.chunked_boundaries(df, ["id"], size=5), catalyst.boundaries(df, ["id"])):
        assert sorted(map(tuple, got.select("id", "char_offset").collect()), key=str) == ends


def test_language_by_row(spark):
    rows = [(1, "en", "Dr. Who came. Fine"), (2, "ja", "はい。Dr. Who came. 「い。」う。"), (3, "xx", "Dr. Who came. Fine"), (4, None, "Dr. Who came. Fine"), (5, "ja", None)]
    df = spark.createDataFrame(rows, "id long, lang string, text string").repartition(2)
    rules = {x: Rules.of(x) for x in ("en", "ja")}
    cut = lambda lang, t: [x for _, _, x in rules.get(lang, rules["en"]).slices(t or "")]
    want = sorted((i, x) for i, lang, t in rows for x in cut(lang, t))
    for got in (segment.sentences(df, ["id"], lang_col="lang"), segment.giant_sentences(df, ["id"], lang_col="lang", size=4)):
        assert sorted(map(tuple, got.select("id", "text").collect())) == want
    arrays = {r["id"]: r["sentences"] for r in segment.sentence_arrays(df, lang_col="lang").collect()}
    assert {i: None if v is None else [x["text"] for x in v] for i, v in arrays.items()} == {i: None if t is None else cut(lang, t) for i, lang, t in rows}
    assert {r["id"]: r["sentence_count"] for r in segment.stats(df, ["id"], lang_col="lang").collect()} == {i: len(rules.get(lang, rules["en"]).boundaries(t or "")) for i, lang, t in rows}


def test_strength_of_ends(spark):
    df = spark.createDataFrame([(1, "Yes! Fine. Why? End.")], "id long, text string")
    assert [(r["char_offset"], r["is_strong"]) for r in segment.boundaries(df, ["id"]).orderBy("offset").collect()] == [(4, True), (10, False), (15, True), (20, False)]


PARTS = ["Dr", "a", "I", "U", "S", "Ph", "etc", "Inc", "p", ".", "...", "…", "!", "?", "!?", "(", ")", '"', "'", "[", " ", "  ", "\n", "é", "É", "word", "the", "3", "no", "。", "「", "」", "！", "K", "　", "\xa0", "um", "cc", "i.e", " The ", "-", "“", "”", "😀", "x" * 40]


@pytest.mark.parametrize("language", ["en", "ja", "custom"])
def test_arrays_agree_with_the_kernel(language):
    """The scan of many texts at once gives what the scan of each gives."""
    rules = Rules.of(LanguageConfig.from_text(CUSTOM) if language == "custom" else language)
    scanner, rng = Scanner(rules), random.Random(3)
    for _ in range(150):
        texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 60))) for _ in range(rng.randint(0, 20))] + [None, ""]
        t = Texts(pa.array(texts, pa.string()))
        ends, strength = scanner.ends(t)
        row = t.row_of(ends)
        assert list(zip(row.tolist(), (ends - t.first[row]).tolist(), strength.tolist(), strict=True)) == [(i, at, s) for i, x in enumerate(texts) for at, d, p, s in rules.scan(x or "").candidates if not p and (not d or max(d) <= 0)]
        for keep in (False, True):
            found = scanner.slices(t, keep)
            got = list(zip(found.row.tolist(), found.idx.tolist(), (found.start - t.first[found.row]).tolist(), (found.end - t.first[found.row]).tolist(), found.text.to_pylist(), strict=True))
            assert got == [(i, k, a, b, s) for i, x in enumerate(texts) for k, (a, b, s) in enumerate(rules.slices(x or "", keep))]


@pytest.mark.parametrize("language", ["en", "ja", "custom"])
def test_states_of_parts_agree_with_the_kernel(language):
    rules = Rules.of(LanguageConfig.from_text(CUSTOM) if language == "custom" else language)
    scanner, rng = Scanner(rules), random.Random(5)
    for _ in range(80):
        texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(rng.randint(1, 12))]
        t = Texts(pa.array(texts, pa.string()))
        low = np.array([rng.randint(0, len(x)) for x in texts]) + t.first[:-1]
        high = np.array([rng.randint(a, b) for a, b in zip(low, t.first[1:], strict=True)])
        got = scanner.states(t, low, high)
        for i, x in enumerate(texts):
            a = t.first[i]
            want, mine = rules.scan(x, int(low[i] - a), int(high[i] - a)), got.row == i
            assert [(at, d, p) for at, d, p, _ in want.candidates] == list(zip((got.places[mine] - low[i]).tolist(), map(tuple, got.depths[mine].tolist()), got.parity[mine].tolist(), strict=True))
            assert want.depths == tuple(got.last_depths[i].tolist()) and want.parity == got.last_parity[i]


def test_catalyst_form_moves_whole_texts_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = catalyst.sentences(df, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" in plan.partition("Exchange")[0]


def test_catalyst_form_has_one_frame_of_rows_and_short_searches(spark):
    """Contexts are made before rows: no window looks at 32 rows for each, and no pattern tries every abbreviation at every place."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = catalyst.sentences(df, ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe(RowFrame, -31" not in plan and "specifiedwindowframe(RowFrame, 1, 32" not in plan and "|etc|" not in plan


def test_catalyst_context_reaches_over_many_short_pieces(spark):
    texts = ["." * n + "(" * k + "a. b" for n in (0, 1, 31, 32, 33, 64) for k in (0, 1, 33)] + ["um" + "." * 40 + " x", "é" * 31 + "." + "!" * 70]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    cuts = ("id", "char_offset", "offset")
    assert rows(catalyst.boundaries(df, ["id"]), *cuts) == rows(segment.boundaries(df, ["id"]), *cuts)

"""Registered queries of the segmentation engine, each with its counterpart in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import clausemill
from clausemill.config import LanguageConfig
from clausemill.functions import sql as functions
from clausemill.operators import segment
from clausemill.plans import catalyst, oracle
from clausemill.ship import shared_path, spread
from clausemill.sources import readers, sinks
from clausemill.streaming import split as streaming

#: Texts that show single rules, beside documents whose marks are replaced so that they meet the rule often.
FIXTURES = {
    "decimal_rule": ["Milk went to 1.25 today. Then 7. 8 came.", "Gravity is 9.81 here. Good.", "7.b. c.9", "Build 11.4. Done."],
    "terminator_patterns": ["Now!? Never?! Sure!! Where??", "Halt!?! Move.", "...?!", "!?!!?"],
    "multi_period": ["She flew in from the U.K.", "Prof. Lee holds an M.B.A. from N.Y.U. in Queens.", "so be it. Ok. We do. ", "They met in Brussels B.C. once.", "J. R. Hartley rang. So. Fine."],
    "abbreviations": ["Mrs. Green runs Bolt Co. and drives down Elm Ave. at night.", "By 9 a.m. it rained. Read no. 12.", "Co! gone. yCo. gone.", "30 cm. 8 km. further", "The U.K. weather turned. So it goes."],
    "starters": ["We sold Bolt Co. The shop closed.", "We sold Bolt Co. However we stayed.", "We sold Bolt Co. Howitzer.", "Pens, ink etc. C d.", "Dr. They left."],
    "ellipsis": ["Hmm... why? Hmm... Why?", "We paused.... Soon we went.", "And… no. And… No. And…… no", ".....", "x... 8. y… ]"],
    "ellipsis_exception": ["Oh um... Next we sang.", "And um... and... Stop.", "We er... Fine. uh... Ah.", "Drum... Fine.", "um... zzzzzzzzzzzzzzzzzzzzzzzz... Fine."],
    "enclosure_depth": ["One line here. [Inner line here.] Last line.", "Later (mid. a rest) he sang! Truly.", "k (l [m. n] o. p) q. r", "{m. n}. o."],
    "quote_parity": ['He wrote "Dear all." Soon (after. lunch) it rained! No?!', 'We "k. l" m. "n. o', "''k. l. 'm. n' o."],
    "suppression_fast": ["Can't wait. \"That's all,\" we said. Rows use 2) here.", "The cats' bowls are full. We're off.", "salt 'n' vinegar. fine."],
    "suppression_regex": ["The door is 6'4\" high. It creaks.", "Turn it 12°15'. Great!", "Look (31). Or (77. y). z.", "It's Anna's hat. 7\" nail. ok."],
    "unbalanced_closers": ["1) Wash it. 2) Dry it.", ") k. (l. m) n. (o. p", "]]] m. [n. o] p."],
}
#: Replacements for the documents of each, applied in order in both engines.
STRESS = {
    "decimal_rule": [(". ", ".5 "), (", ", " 7.")],
    "terminator_patterns": [(". ", "!? "), (", ", "?! ")],
    "multi_period": [(" the ", " U.S.A. "), (" of ", " Ph.D. ")],
    "abbreviations": [(" the ", " Inc. "), (" of ", " etc. "), (" and ", " No. ")],
    "starters": [(" the ", " Inc. The "), (" of ", " p.m. However "), (" and ", " Dr. Then ")],
    "ellipsis": [(". ", "... "), (", ", "… "), (" and ", ".... ")],
    "ellipsis_exception": [(" the ", " um... "), (". ", "... "), (" of ", " er... ")],
    "enclosure_depth": [(", ", " ("), (" the ", ") "), (" of ", " [x. y] ")],
    "quote_parity": [(" the ", ' "'), (", ", '" '), (" of ", ' "q. r" ')],
    "suppression_fast": [(" the ", " it's "), (" of ", " boys' "), (", ", " 'x. ")],
    "suppression_regex": [(" the ", " 5'9\" "), (" of ", " (12) "), (" and ", " 45°30' ")],
    "unbalanced_closers": [(", ", ") "), (" the ", " (a. ")],
}
CUSTOM = """
[metadata]
code = "x"
name = "Custom"
[terminators]
chars = [".", ";", "!"]
patterns = [{ pattern = ";;", name = "double" }, { pattern = "!!!", name = "triple" }]
[ellipsis]
treat_as_boundary = false
patterns = [".."]
[enclosures]
pairs = [{ open = "<", close = ">" }, { open = "|", close = "|", symmetric = true }]
[suppression]
fast_patterns = [{ char = "|", before = "digit" }, { char = ">", line_start = true, before = "alnum" }]
[abbreviations]
some = ["bzw", "d.h"]
[sentence_starters]
require_following_space = false
min_word_length = 2
some = ["Der", "I"]
"""
CUSTOM_FIXTURES = ["a; b;; c. d", "a!!! b! c", "x.. Y. bzw. Der z. d.h. so", "<a. b> c. 5| d. |e. f| g.", "q> r. s", "bzw. Dersim. bzw. I."]
JA_FIXTURES = ["母は「おかえり」と笑った。明日は雨!傘は?", "母は『手紙「追伸」だ』と読んだ。以上。", "駅は近い。幅は2.4です。本当!?", "「箱の中。」と外。", "犬は走った……そして寝た。夜だ。", "あの…では。はい！？うん"]
JA_STRESS = [(". ", "。"), (", ", "「"), (" the ", "」"), (" of ", "……"), (".", "。")]


def _replaced(pairs: list[tuple[str, str]]) -> str:
    sql = "text"
    for a, b in pairs:
        sql = f"replace({sql}, {oracle.text_of(a)}, {oracle.text_of(b)})"
    return sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cases(spark: SparkSession, sf_dir: str, pairs: list[tuple[str, str]], fixtures: list[str]) -> DataFrame:
    replaced = F.col("text")
    for a, b in pairs:
        replaced = F.replace(replaced, F.lit(a), F.lit(b))
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("case_id"), replaced.alias("text"))
    # dealt out here, as the size of the union is not known
    return spread(docs).unionByName(spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(fixtures)], "case_id string, text string"))


def _cases_sql(pairs: list[tuple[str, str]], fixtures: list[str]) -> str:
    rows = ", ".join(f"('f{i}', {oracle.text_of(t)})" for i, t in enumerate(fixtures))
    return f"SELECT 'd' || doc_id AS key, {_replaced(pairs)} AS text FROM documents UNION ALL SELECT * FROM (VALUES {rows}) v(key, text)"


DOCS = "SELECT doc_id AS key, text FROM documents"
_SLICE = ("doc_id", "idx", "text", "start", "end", "start_byte", "end_byte")


def sentences_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sentences(_table(spark, sf_dir, "documents"), ["doc_id"])


def boundaries_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.boundaries(_table(spark, sf_dir, "documents"), ["doc_id"]).drop("is_strong")


def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.stats(_table(spark, sf_dir, "documents"), ["doc_id"])


def details_preserve_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sentences(_table(spark, sf_dir, "documents"), ["doc_id"], preserve_whitespace=True)


def catalyst_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalyst.sentences(_table(spark, sf_dir, "documents"), ["doc_id"])


def chunked_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.chunked_boundaries(_table(spark, sf_dir, "documents"), ["doc_id"], size=1000)


def giant_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.giant_sentences(_table(spark, sf_dir, "documents"), ["doc_id"], size=2000)


def conversation_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sentences(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"]).select("conv_id", "turn", "idx", "text")


def benchmark_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sentences(_table(spark, sf_dir, "benchmark"), ["item_id"])


def page_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.boundaries(_table(spark, sf_dir, "pages"), ["page_id"], text_col="html").drop("is_strong")


def classified_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalyst.classified(_table(spark, sf_dir, "documents"))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.text_lines(sentences_en(spark, sf_dir), ["doc_id"])


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.json_rows(sentences_en(spark, sf_dir), ["doc_id"])


def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.markdown_rows(sentences_en(spark, sf_dir), ["doc_id"], footer=True)


def sql_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions.register(spark)
    docs = _table(spark, sf_dir, "benchmark")
    return spark.sql("SELECT b.item_id, s.idx, s.text, s.start, s.end, s.start_byte, s.end_byte FROM {docs} b, LATERAL sentences(b.text, 'en') s", docs=docs)


def sql_sentence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions.register(spark)
    docs = _table(spark, sf_dir, "documents")
    return spark.sql("SELECT lang, sum(sentence_count(text, 'en')) AS n_sentences, count(*) AS n_docs FROM {docs} GROUP BY lang", docs=docs)


def streaming_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as streams of fragments of 40 characters, one stream for each message, all available data at once.

    The path is a pattern, since a stream takes a folder or a pattern, and the table may be one file.
    """
    schema = _table(spark, sf_dir, "conversations").schema
    messages = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parque[t]").where("length(text) > 0")
    last = F.floor((F.length("text") - 1) / 40).cast("int")
    parts = messages.select(F.concat_ws(":", "conv_id", "turn").alias("stream_key"), "text", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("seq"))
    fragments = parts.select("stream_key", "seq", F.substring("text", F.col("seq") * 40 + 1, F.lit(40)).alias("fragment"), (F.col("seq") == F.col("last")).alias("is_last"))
    out = shared_path(spark, "stream")
    query = streaming.split_stream(fragments).writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
    query.awaitTermination()
    return spark.read.schema(streaming.OUT).parquet(f"{out}/rows")


def _rule(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.boundaries(_cases(spark, sf_dir, STRESS[name], FIXTURES[name]), ["case_id"]).drop("is_strong")


def sentences_ja(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sentences(_cases(spark, sf_dir, JA_STRESS, JA_FIXTURES), ["case_id"], "ja")


def catalyst_ja(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalyst.boundaries(_cases(spark, sf_dir, JA_STRESS, JA_FIXTURES), ["case_id"], "ja")


def custom_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.boundaries(_cases(spark, sf_dir, [(". ", ";; "), (", ", " |"), (" the ", " bzw. ")], CUSTOM_FIXTURES), ["case_id"], LanguageConfig.from_text(CUSTOM)).drop("is_strong")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document in Japanese marks."""
    text = F.col("text")
    for a, b in JA_STRESS:
        text = F.replace(text, F.lit(a), F.lit(b))
    third = F.col("doc_id") % 3 == 0
    return _table(spark, sf_dir, "documents").select("doc_id", F.when(third, "ja").otherwise(F.col("lang")).alias("lang"), F.when(third, text).otherwise(F.col("text")).alias("text"))


def language_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sentences(_mixed(spark, sf_dir), ["doc_id"], lang_col="lang")


def language_by_row_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.chunked_boundaries(_mixed(spark, sf_dir), ["doc_id"], size=1500, lang_col="lang")


def utf8_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts from bytes that begin with a byte-order mark, which stays."""
    raw = _table(spark, sf_dir, "documents").select("doc_id", F.encode(F.concat(F.lit("\ufeff"), "text"), "UTF-8").alias("content"))
    return segment.sentences(raw.select("doc_id", readers.from_bytes(F.col("content")).alias("text")), ["doc_id"])


def latin1_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _table(spark, sf_dir, "documents").select("doc_id", F.encode(F.regexp_replace("text", r"[^\x00-\xff]", "?"), "ISO-8859-1").alias("content"))
    return segment.sentences(raw.select("doc_id", readers.from_bytes(F.col("content"), "latin-1").alias("text")), ["doc_id"])


def _blank_too(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.union(spark.createDataFrame([(-1, ""), (-2, " \n "), (-3, None)], "doc_id long, text string"))


def split_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`split` of a DataFrame: an array of sentences beside each text."""
    found = clausemill.split(_blank_too(spark, sf_dir), preserve_whitespace=True)
    return found.select("doc_id", F.posexplode("sentences").alias("idx", "s")).select("doc_id", "idx", "s.text", "s.start", "s.end")


def split_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`split` of a column: arrays of texts, null for null."""
    return _blank_too(spark, sf_dir).select("doc_id", clausemill.split(F.col("text")).alias("s")).select("doc_id", F.array_size("s").alias("n"), F.array_join("s", "|").alias("joined"))


def splitter_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A splitter gives a text without sentences itself, trimmed."""
    found = clausemill.load("en").split(_blank_too(spark, sf_dir))
    return found.select("doc_id", F.posexplode("sentences").alias("idx", "s")).select("doc_id", "idx", "s.text", "s.start", "s.end")


def fragment_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as a table of fragments of 40 characters."""
    messages = _table(spark, sf_dir, "conversations").where("length(text) > 0")
    last = F.floor((F.length("text") - 1) / 40).cast("int")
    parts = messages.select(F.concat_ws(":", "conv_id", "turn").alias("stream_key"), "text", F.explode(F.sequence(F.lit(0), last)).alias("seq"))
    return streaming.split_batches(parts.select("stream_key", "seq", F.substring("text", F.col("seq") * 40 + 1, F.lit(40)).alias("fragment")))


_PLAIN = (sentences_en, boundaries_en, sentence_stats, details_preserve_ws, catalyst_sentences, chunked_invariance, giant_sentences, conversation_sentences, benchmark_sentences, page_boundaries, classified_chars, text_lines, json_lines, markdown_lines, sql_table_function, sql_sentence_count, streaming_split, sentences_ja, catalyst_ja, custom_language, language_by_row, language_by_row_chunks, utf8_bytes, latin1_bytes, split_frame, split_column, splitter_frame, fragment_batches)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _PLAIN} | {name: partial(_rule, name) for name in FIXTURES}


def oracle_sql() -> dict[str, str]:
    en = "en"
    slices = oracle.sentences(DOCS, en, "doc_id")
    messages = "SELECT conv_id || ':' || turn AS key, text FROM conversations"
    ja = _cases_sql(JA_STRESS, JA_FIXTURES)
    mixed = (f"SELECT doc_id AS key, {_replaced(JA_STRESS)} AS text FROM documents WHERE doc_id % 3 = 0", "SELECT doc_id AS key, text FROM documents WHERE doc_id % 3 <> 0")
    out = {
        "sentences_en": slices,
        "boundaries_en": oracle.boundaries(DOCS, en, "doc_id"),
        "sentence_stats": oracle.stats(DOCS, en),
        "details_preserve_ws": oracle.sentences(DOCS, en, "doc_id", True),
        "catalyst_sentences": oracle.sentences(DOCS, en, "doc_id", columns='idx, text, start, "end"'),
        "chunked_invariance": oracle.boundaries(DOCS, en, "doc_id"),
        "giant_sentences": slices,
        "conversation_sentences": f"SELECT split_part(key, ':', 1)::BIGINT AS conv_id, split_part(key, ':', 2)::BIGINT AS turn, idx, text FROM ({oracle.sentences(messages, en, 'key', columns='idx, text')})",
        "benchmark_sentences": oracle.sentences("SELECT item_id AS key, text FROM benchmark", en, "item_id"),
        "page_boundaries": oracle.boundaries("SELECT page_id AS key, html AS text FROM pages", en, "page_id"),
        "classified_chars": oracle.classified(DOCS, en),
        "text_lines": f"SELECT text AS value FROM ({slices})",
        "json_lines": f"SELECT doc_id, idx, to_json({{'text': text, 'offset': start_byte, 'length': strlen(text)}})::VARCHAR AS value FROM ({slices})",
        "markdown_lines": f"WITH s AS MATERIALIZED ({slices}) SELECT n, n || '. ' || text AS value FROM (SELECT row_number() OVER (ORDER BY doc_id, idx) AS n, text FROM s) UNION ALL SELECT count(*) + 1, chr(10) || '---' || chr(10) || '*Total sentences: ' || count(*) || '*' FROM s",
        "sql_table_function": oracle.sentences("SELECT item_id AS key, text FROM benchmark", en, "item_id"),
        "sql_sentence_count": f"SELECT lang, sum(sentence_count)::BIGINT AS n_sentences, count(*) AS n_docs FROM ({oracle.stats(DOCS, en)}) s JOIN documents d ON s.doc_id = d.doc_id GROUP BY lang",
        "streaming_split": f"SELECT key AS stream_key, idx::BIGINT AS idx, text FROM ({oracle.sentences(messages, en, 'key', columns='idx, text')})",
        "sentences_ja": oracle.sentences(ja, "ja"),
        "catalyst_ja": oracle.boundaries(ja, "ja"),
        "language_by_row": f"SELECT * FROM ({oracle.sentences(mixed[0], 'ja', 'doc_id')}) UNION ALL SELECT * FROM ({oracle.sentences(mixed[1], en, 'doc_id')})",
        "language_by_row_chunks": f"SELECT * FROM ({oracle.boundaries(mixed[0], 'ja', 'doc_id')}) UNION ALL SELECT * FROM ({oracle.boundaries(mixed[1], en, 'doc_id')})",
        "utf8_bytes": oracle.sentences("SELECT doc_id AS key, chr(65279) || text AS text FROM documents", en, "doc_id"),
        "latin1_bytes": oracle.sentences("SELECT doc_id AS key, regexp_replace(text, '[^\\x{00}-\\x{ff}]', '?', 'g') AS text FROM documents", en, "doc_id"),
        "split_frame": oracle.sentences(DOCS, en, "doc_id", True, columns='idx, text, start, "end"'),
        "split_column": f"WITH s AS ({slices}) SELECT doc_id, count(s.text)::INTEGER AS n, coalesce(string_agg(s.text, '|' ORDER BY idx), '') AS joined FROM documents LEFT JOIN s USING (doc_id) WHERE documents.text IS NOT NULL GROUP BY doc_id UNION ALL VALUES (-1, 0, ''), (-2, 0, ''), (-3, NULL, NULL)",
        "splitter_frame": f"SELECT doc_id, idx, text, start, \"end\" FROM ({slices}) UNION ALL VALUES (-1, 0, '', 0, 0), (-2, 0, '', 0, 3)",
        "fragment_batches": f"SELECT key AS stream_key, idx::BIGINT AS idx, text FROM ({oracle.sentences(messages, en, 'key', columns='idx, text')})",
        "custom_language": oracle.boundaries(_cases_sql([(". ", ";; "), (", ", " |"), (" the ", " bzw. ")], CUSTOM_FIXTURES), LanguageConfig.from_text(CUSTOM)),
    }
    return out | {name: oracle.boundaries(_cases_sql(STRESS[name], FIXTURES[name]), en) for name in FIXTURES}

"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a file is addressed by the SHA-256 of its content. The ledger holds a row for each pair of blob and
rule version that was scanned; a run scans only pairs that it lacks, appends them, and joins findings back to all paths.

Cases: null text counts as empty; repeated rows share one blob and each get the findings; rows without an id take part
like others; a pair that stands in the ledger more than once counts as one; an empty table gives an empty result; columns
beside `id_col` and `text_col` are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausemill.llm.shared import saved, shared_path


@dataclass(frozen=True)
class Rule:
    """`find` is matched leftmost and non-overlapping; matches whose `group` is under `least` characters are dropped.

    `hint` is a cheaper pattern that any text with a kept match contains.
    """

    kind: str
    find: str
    hint: str
    group: int = 0
    least: int = 1


_ASSIGN = r"(?:(?i)(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
BASE = (
    Rule("assign", _ASSIGN + "([A-Za-z0-9+/_.=-]+)", _ASSIGN + "[A-Za-z0-9+/_.=-]{12}", 1, 12),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{14}", 0, 18),
    Rule("hex", "[0-9a-f]{16,}", "[0-9a-f]{16}", 0, 16),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----[A-Za-z0-9+/=\s:,.;()-]*?-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----", "PRIVATE KEY"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-[A-Za-z0-9-]{10}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}", "AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", "[rs]k_live_[0-9A-Za-z]{16,}", "[rs]k_live_[0-9A-Za-z]{16}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ"),
)
RULES = BASE + ADDED
#: Any text with a match of an added rule has one of these.
_ADDED_HINT = "PRIVATE KEY|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10}|AIza[0-9A-Za-z_-]{35}|[rs]k_live_|eyJ[A-Za-z0-9_-]{8}"
LEDGER = "blob string, rule_version string, spans array<struct<start:long,kind_no:int,end:long>>"


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _matches(text: Column, no: int, rule: Rule, may: Column) -> Column:
    """For each match its rule, place in the row of matches, the characters before it since the last one, its own, and whether it is kept."""
    kind = "array<struct<no:int,at:int,gap:int,len:int,ok:boolean>>"
    find = F.lit(rule.find)
    whole = F.regexp_extract_all(text, find, F.lit(0))
    part = F.regexp_extract_all(text, find, F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.find, -1)
    both = F.arrays_zip(whole.alias("m"), part.alias("p"), F.slice(gaps, 1, F.size(whole)).alias("g"))
    rows = F.transform(both, lambda x, i: F.struct(F.lit(no).alias("no"), i.alias("at"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), (F.length(x["p"]) >= rule.least).alias("ok")))
    return F.when(may & text.rlike(rule.hint), rows.cast(kind)).otherwise(F.array().cast(kind))


def scan_texts(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text), a row for each blob -> (blob, spans), spans sorted by start, then rule. Offsets in code points."""
    text = F.col("text")
    odd = F.col("odd")
    per_rule = [_matches(text, no, r, odd if r in ADDED else F.lit(True)) for no, r in enumerate(rules)]
    found = (
        blobs.withColumn("odd", text.rlike(_ADDED_HINT))
        .select("blob", F.flatten(F.array(*per_rule)).alias("hits"))
        .where(F.size("hits") > 0)
        .select("blob", F.inline("hits"))
        .dropDuplicates(["blob", "no", "at"])  # rows that repeat with their id bring a blob twice
    )
    run = Window.partitionBy("blob", "no").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = found.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("len")).over(run)).where("ok")
    return placed.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("len")).alias("start"), F.col("no").alias("kind_no"), "end"))).alias("spans"))


def scan(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: (id_col, blob, spans); spans is empty where nothing was found.

    `ledger_path` is a Parquet folder that is created or appended to; by default one in the shared folder.
    """
    spark = docs.sparkSession
    version = rule_version(rules)
    kept = docs.select(F.col(id_col).alias("path_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    addressed = kept.withColumn("blob", F.sha2("text", 256)).withColumn("key", F.coalesce(F.col("path_id").cast("string"), F.lit("")))
    versions = saved(addressed.select("path_id", "key", "blob"), "secret-versions")
    ledger = _read_ledger(spark, ledger_path).where(F.col("rule_version") == version)
    unseen = versions.groupBy("blob").agg(F.min("key").alias("key")).join(ledger.select("blob"), "blob", "left_anti")
    texts = unseen_texts(addressed, unseen)
    found = scan_texts(texts, rules)
    entries = unseen.select("blob").join(found, "blob", "left").select("blob", F.lit(version).alias("rule_version"), F.coalesce("spans", F.array()).alias("spans"))
    path = ledger_path or shared_path(spark, "secret-ledger")
    entries.write.mode("append").parquet(path)
    spans = spark.read.schema(LEDGER).parquet(path).where((F.col("rule_version") == version) & (F.size("spans") > 0)).select("blob", "spans")
    # A pair stands twice where two runs met or one was repeated; both rows have the same spans.
    # Written, so that the join below reads both sides from exchanges and AQE can split a blob of many paths.
    spans = saved(spans.groupBy("blob").agg(F.first("spans").alias("spans")), "secret-spans")
    none = F.array().cast("array<struct<start:long,kind_no:int,end:long>>")
    return versions.join(spans, "blob", "left").select(F.col("path_id").alias(id_col), "blob", F.coalesce("spans", none).alias("spans"))


def unseen_texts(addressed: DataFrame, unseen: DataFrame) -> DataFrame:
    """(blob, text) of one row of each unseen blob. Only narrow rows are built into a hash table; a few are broadcast by AQE."""
    texts = addressed.select("blob", "key", "text").join(unseen.hint("shuffle_hash"), ["blob", "key"], "left_semi")
    # A condition that is not deterministic, though always true, keeps the optimizer from scanning all texts before the join.
    return texts.where(F.monotonically_increasing_id() >= 0).select("blob", "text")


def _read_ledger(spark: SparkSession, path: str | None) -> DataFrame:
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.read.schema(LEDGER).parquet(path)
    return spark.createDataFrame([], LEDGER)


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with every found span, overlapping ones merged, replaced by [kind]; n_chars follows. Other texts stay as they are.

    Findings join by blob; where they are few, AQE broadcasts them and texts stay where they lie.
    """
    found = scan(docs, ledger_path, rules).where(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    text = F.col("text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("to"))
    step = lambda a, s: F.struct(
        F.when(s["start"] >= a["to"], F.concat(a["out"], F.substring(text, (a["to"] + 1).cast("int"), (s["start"] - a["to"]).cast("int")), F.lit("["), F.get(kinds, s["kind_no"]), F.lit("]"))).otherwise(a["out"]).alias("out"),
        F.greatest(a["to"], s["end"]).alias("to"),
    )
    clean = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.expr("substring(text, cast(aggregate(spans, 0L, (m, s) -> greatest(m, s.end)) as int) + 1)")))
    joined = docs.withColumn("_blob", F.sha2(F.coalesce(text, F.lit("")), 256)).join(found.withColumnRenamed("blob", "_blob"), "_blob", "left")
    out = joined.withColumn("text", F.when(F.col("spans").isNull(), text).otherwise(clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)

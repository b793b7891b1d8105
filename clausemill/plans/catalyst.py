"""The rules compiled into column expressions: pieces, one window pass, a filter. No Python runs on executors.

A text is split after every special character. The pieces get their context as an array, before rows are made of them (pieces
have a character at least, so 32 on each side hold all that a rule may read): each is put together with the one beside it,
then with the two, four, eight and sixteen beside those. One window by row gives each piece its place and, by running sums,
depths and parities. Rows are
numbered and dealt by their numbers before they are split: one exchange of whole texts, none of pieces, and rows that share
their keys are texts of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.config import REACH, LanguageConfig
from clausemill.kernel import ABBREVIATION, ENCLOSURE, LINE, NEAR, SLICE_BYTES, Rules
from clausemill.operators.segment import trim

#: Classes as the rules mean them.
CLASSES = {"alpha": r"\p{IsAlphabetic}", "alnum": r"[\p{IsAlphabetic}\p{N}]", "digit": "[0-9]", "whitespace": r"\p{IsWhite_Space}"}


def quoted(text: str) -> str:
    """A literal in a Java pattern."""
    return re.sub(r"([\\^$.|?*+()\[\]{}&~#\-\s])", r"\\\1", text)


def one_of(words: list[str]) -> str:
    return "(?:" + "|".join(map(quoted, words)) + ")"


def _any(columns: list[Column]) -> Column:
    return reduce(Column.__or__, columns, F.lit(False))


def special_class(rules: Rules) -> str:
    return "[" + "".join(map(quoted, sorted(rules.judged | set(rules.enclosures)))) + "]"


def judge(rules: Rules, left: Column, c: Column, right: Column) -> Column:
    """Whether the terminator `c` ends a sentence, from the up to 31 characters before and 32 after it."""
    config = rules.config
    upto = F.concat(left, c)
    near = F.left(right, F.lit(NEAR))
    ends = lambda words: _any([upto.endswith(w) for w in words])
    goes_on = _any([(upto.endswith(a) if a else F.lit(True)) & right.startswith(b) for a, b in rules.run_continues])
    first = F.regexp_extract(near, r"\p{IsAlphabetic}", 0)
    ellipsis = F.lit(config.ellipsis.treat_as_boundary)
    for rule in reversed(config.ellipsis.context_rules):
        kind = {"followed_by_capital": r"\p{IsUppercase}", "followed_by_lowercase": r"\p{IsLowercase}"}.get(rule.condition)
        if kind:
            ellipsis = F.when(first.rlike(kind), F.lit(rule.boundary)).otherwise(ellipsis)
    piece = F.concat(_bytes_back(left), _bytes_ahead(F.concat(c, right)))
    for e in reversed(config.ellipsis.exceptions):
        ellipsis = F.when(piece.rlike(f"(?U){e.regex}"), F.lit(e.boundary)).otherwise(ellipsis)
    a = CLASSES["alpha"]
    initials = near.rlike(rf"\A\p{{IsWhite_Space}}*{a}{{1,2}}\.") & F.right(left, F.lit(NEAR)).rlike(rf"(?:\A|[^{a}]){a}{{1,2}}\z")
    dot = c == "."
    word = F.regexp_extract(near, rf"\A\p{{IsWhite_Space}}*({a}+)", 1)
    space = F.lit(True) if not rules.starter_space else near.rlike(rf"\A\p{{IsWhite_Space}}*{a}+\p{{IsWhite_Space}}")
    starter = word.isin(*sorted(rules.starters)) & space if rules.starters else F.lit(False)
    digits = left.rlike(r"[0-9]\z") & right.rlike(r"\A[0-9]")
    plain = F.when(c.isin("!", "?", "！", "？"), True).when(c.isin(".", "。"), ~digits).otherwise(False)
    return (
        F.when(ends(rules.ellipses) & ~goes_on, ellipsis)
        .when(dot & near.startswith("."), False)
        .when(dot & initials, False)
        .when(~c.isin(*sorted(rules.terminators)), False)
        .when(ends([p.pattern for p in config.terminators.patterns if p.pattern]), True)
        .when(F.concat(c, F.left(right, F.lit(1))).isin(*sorted(rules.pairs_ahead)) if rules.pairs_ahead else F.lit(False), False)
        .when(_abbreviated(rules, left), (word == "") | starter)
        .otherwise(plain)
    )


def _abbreviated(rules: Rules, left: Column) -> Column:
    """The longest abbreviation at the end of `left` begins a word; a shorter one does not stand in for it."""
    if not rules.abbreviations:
        return F.lit(False)

    def longest(lowered: Column) -> Column:
        found = F.lit("")
        for n in sorted({len(w) for w in rules.abbreviations}):
            end = F.right(lowered, F.lit(n))
            found = F.when(end.isin(*sorted(w for w in rules.abbreviations if len(w) == n)), end).otherwise(found)
        return found

    def begins_a_word(found: Column) -> Column:
        before = F.left(F.right(left, F.length(found) + 1), F.length(F.right(left, F.length(found) + 1)) - F.length(found))
        return (found != "") & ~before.rlike(CLASSES["alnum"])

    return _let(_let(F.lower(F.right(left, F.lit(ABBREVIATION))), longest), begins_a_word)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def _bytes_back(text: Column, size: int = SLICE_BYTES) -> Column:
    """The last `size` bytes, from the start of the character that they begin in."""
    kept = F.lit("")
    for n in range(1, size + 1):
        kept = F.when((F.length(text) >= n) & (F.octet_length(F.right(text, F.lit(n - 1)) if n > 1 else F.lit("")) < size), F.right(text, F.lit(n))).otherwise(kept)
    return kept


def _bytes_ahead(text: Column, size: int = SLICE_BYTES) -> Column:
    kept = F.lit("")
    for n in range(1, size + 1):
        kept = F.when((F.length(text) >= n) & (F.octet_length(F.left(text, F.lit(n - 1)) if n > 1 else F.lit("")) < size), F.left(text, F.lit(n))).otherwise(kept)
    return kept


def suppressed(rules: Rules, left: Column, c: Column, right: Column) -> Column:
    """Whether the enclosure character `c` is none."""
    tests = []
    for char, patterns in sorted(rules.fast.items()):
        for f in patterns:
            test = c == char
            if f.line_start:
                test &= ~F.right(left, F.lit(LINE)).rlike(rf"\A[^\n]{{{LINE}}}\z")
            if f.before is not None:
                test &= left.rlike(rf"{CLASSES[f.before]}\z") if f.before in CLASSES else F.lit(False)
            if f.after is not None:
                test &= right.rlike(rf"\A{CLASSES[f.after]}") if f.after in CLASSES else F.lit(False)
            tests.append(test)
    if rules.config.suppression.regex_patterns:
        window = F.concat(F.right(left, F.lit(ENCLOSURE)), c, F.left(right, F.lit(ENCLOSURE)))
        tests += [window.rlike(f"(?U){p.pattern}") for p in rules.config.suppression.regex_patterns]
    return _any(tests)


def _apart(rule: Callable[..., Column], rules: Rules, *columns: Column) -> Column:
    """The rule of the columns in a lambda, which is evaluated as a tree: as generated code it is a method too long for the JVM
    to compile, and runs many times slower."""
    row = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(columns)])
    return _let(row, lambda e: rule(rules, *[e[f"_{i}"] for i in range(len(columns))]))


def _with_context(df: DataFrame) -> DataFrame:
    """df with, for each of _pieces, the last 32 characters up to its end (_upto) and the first 32 behind it (_right)."""
    reach = F.lit(REACH)
    df = df.withColumn("_upto", F.transform("_pieces", lambda x: F.right(x, reach))).withColumn("_right", F.transform("_pieces", lambda x: F.left(x, reach)))
    beside = lambda name, at: F.coalesce(F.get(F.col(name), at), F.lit(""))
    for step in (1 << i for i in range((REACH - 1).bit_length())):
        back = F.transform("_upto", lambda x, i: F.right(F.concat(beside("_upto", i - step), x), reach))  # noqa: B023
        ahead = F.transform("_right", lambda x, i: F.left(F.concat(x, beside("_right", i + step)), reach))  # noqa: B023
        df = df.withColumns({"_upto": back, "_right": ahead})
    return df.withColumn("_right", F.transform("_right", lambda x, i: beside("_right", i + 1)))


def events(df: DataFrame, keys: list[str], language: str | LanguageConfig = "en", text_col: str = "text") -> DataFrame:
    """keys, _row, k, piece, end_char, end_byte, c, is_boundary: a row for each piece of each text."""
    rules = Rules.of(language)
    dealt = df.select(*keys, text_col, F.monotonically_increasing_id().alias("_row")).repartition("_row")
    cut = _with_context(dealt.select(*keys, "_row", F.split(text_col, f"(?<={special_class(rules)})", -1).alias("_pieces")))
    pieces = cut.select(*keys, "_row", F.posexplode(F.arrays_zip("_pieces", "_upto", "_right")).alias("k", "p"))
    pieces = pieces.select(*keys, "_row", "k", F.col("p._pieces").alias("piece"), F.col("p._upto").alias("upto"), F.col("p._right").alias("right")).where("piece <> ''")
    so_far = Window.partitionBy("_row").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    seen = pieces.select(
        *keys, "_row", "k", "piece", "upto", "right",
        F.sum(F.length("piece")).over(so_far).alias("end_char"), F.sum(F.octet_length("piece")).over(so_far).alias("end_byte"),
    ).withColumn("c", F.right("piece", F.lit(1))).withColumn("left", F.left("upto", F.length("upto") - 1))
    left, c, right = F.col("left"), F.col("c"), F.col("right")
    if rules.enclosures:
        seen = seen.withColumn("real", F.when(c.isin(*sorted(rules.enclosures)), ~_apart(suppressed, rules, left, c, right)).otherwise(False))
        opens = F.lit(True)
        for slot in range(rules.n_depths):
            step = F.lit(0)
            for char, (symmetric, at, delta) in rules.enclosures.items():
                if not symmetric and at == slot:
                    step = F.when(c == char, delta).otherwise(step)
            opens &= F.sum(F.when(F.col("real"), step).otherwise(0)).over(so_far) <= 0
        flips: dict[int, list[str]] = {}
        for char, (symmetric, at, _) in rules.enclosures.items():
            if symmetric:
                flips.setdefault(at, []).append(char)
        for chars in flips.values():
            opens &= F.sum(F.when(F.col("real") & c.isin(*chars), 1).otherwise(0)).over(so_far) % 2 == 0
        seen = seen.withColumn("outside", opens)
    else:
        seen = seen.withColumn("outside", F.lit(True))
    boundary = F.when(c.isin(*sorted(rules.judged)) & F.col("outside"), _apart(judge, rules, left, c, right)).otherwise(False)
    return seen.select(*keys, "_row", "k", "piece", "end_char", "end_byte", "c", boundary.alias("is_boundary"))


def boundaries(df: DataFrame, keys: list[str], language: str | LanguageConfig = "en", text_col: str = "text") -> DataFrame:
    return events(df, keys, language, text_col).where("is_boundary").select(*keys, F.col("end_char").alias("char_offset"), F.col("end_byte").alias("offset"))


def sentences(df: DataFrame, keys: list[str], language: str | LanguageConfig = "en", text_col: str = "text", preserve_whitespace: bool = False) -> DataFrame:
    """keys, idx, text, start, end, put together from the pieces: the text does not travel beside them."""
    run = Window.partitionBy("_row").orderBy("k")
    numbered = events(df, keys, language, text_col).withColumn("no", F.coalesce(F.sum(F.col("is_boundary").cast("int")).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "")
    whole = numbered.groupBy("_row", *keys, "no").agg(raw.alias("raw"), F.max("end_char").alias("end")).withColumn("start", F.col("end") - F.length("raw"))
    kept = whole.withColumn("bare", trim(F.col("raw"))).where("bare <> ''")
    order = Window.partitionBy("_row").orderBy("no")
    return kept.select(*keys, (F.row_number().over(order) - 1).cast("int").alias("idx"), (F.col("raw") if preserve_whitespace else F.col("bare")).alias("text"), "start", "end")


def classified(df: DataFrame, language: str | LanguageConfig = "en", text_col: str = "text") -> DataFrame:
    """class, c, n: how often each special character occurs, by its class."""
    rules = Rules.of(language)
    c = F.explode(F.regexp_extract_all(text_col, F.lit(special_class(rules)), F.lit(0)))
    kind = F.when(F.col("c").isin(*sorted(rules.judged & set(rules.enclosures))), "both").when(F.col("c").isin(*sorted(rules.judged)), "terminator").otherwise("enclosure")
    return df.select(c.alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).select(kind.alias("class"), "c", "n")

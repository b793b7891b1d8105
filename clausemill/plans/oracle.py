"""The same rules as DuckDB SQL, for checks: contexts by position in the text instead of neighbouring pieces, RE2 patterns.

RE2 knows no Unicode Alphabetic class, so letters and marks stand for it; inputs of checks keep to where they agree.
"""

from __future__ import annotations

import re

from clausemill.config import LanguageConfig
from clausemill.kernel import Rules

ALPHA, SPACE = r"\p{L}", r"\t-\r \x{85}\p{Z}"
_KINDS = {"alpha": rf"[{ALPHA}]", "alnum": rf"[{ALPHA}\p{{N}}]", "digit": "[0-9]", "whitespace": f"[{SPACE}]"}


def text_of(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re(s: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}\-])", r"\\\1", s)


def _unicode(pattern: str) -> str:
    """Word characters, digits and the word edges that stand at the ends of a pattern as in a Unicode-aware engine."""
    if pattern.startswith(r"\b"):
        pattern = r"(?:^|[^\w])" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + r"(?:$|[^\w])"
    pattern = pattern.replace(r"[^\w]", r"[^\p{L}\p{M}\p{Nd}_]")
    return pattern.replace(r"\w", r"[\p{L}\p{M}\p{Nd}_]").replace(r"\d", r"\p{Nd}").replace(r"\s", f"[{SPACE}]")


def _like(subject: str, pattern: str) -> str:
    return f"regexp_matches({subject}, {text_of('(?s)' + pattern)})"


def _or(tests: list[str]) -> str:
    return "(" + " OR ".join(tests) + ")" if tests else "false"


def _in(subject: str, values) -> str:
    return f"{subject} IN ({', '.join(map(text_of, sorted(values)))})" if values else "false"


def _bytes(side: str, text: str) -> str:
    return f"{side}({text}, coalesce(list_max([n FOR n IN range(1, 21) IF length({text}) >= n AND strlen({side}({text}, n - 1)) < 20]), 0))"


def _judge(rules: Rules) -> str:
    config = rules.config
    upto = "(l || c)"
    near = "left(r, 10)"
    ends = lambda words: _or([f"suffix({upto}, {text_of(w)})" for w in words])
    goes_on = _or([f"(suffix({upto}, {text_of(a)}) AND prefix(r, {text_of(b)}))" for a, b in rules.run_continues])
    first = f"regexp_extract({near}, '[{ALPHA}]')"
    arms = [f"WHEN {_like('(' + _bytes('right', 'l') + ' || ' + _bytes('left', '(c || r)') + ')', _unicode(e.regex))} THEN {e.boundary}" for e in config.ellipsis.exceptions]
    for rule in config.ellipsis.context_rules:
        kind = {"followed_by_capital": r"\p{Lu}", "followed_by_lowercase": r"\p{Ll}"}.get(rule.condition)
        if kind:
            arms.append(f"WHEN {_like(first, kind)} THEN {rule.boundary}")
    default = str(config.ellipsis.treat_as_boundary)
    ellipsis = f"CASE {' '.join(arms)} ELSE {default} END" if arms else default
    initials = f"({_like('right(l, 10)', rf'(?:^|[^{ALPHA}])[{ALPHA}]{{1,2}}$')} AND {_like(near, rf'^[{SPACE}]*[{ALPHA}]{{1,2}}[.]')})"
    words = sorted(rules.abbreviations, key=lambda w: (-len(w), w))
    pattern = "(?:" + "|".join(map(_re, words)) + ")$"
    found = f"regexp_extract(lower(right(l, 21)), {text_of(pattern)})"
    abbreviated = f"({found} <> '' AND NOT {_like(f'left(right(l, length({found}) + 1), length(right(l, length({found}) + 1)) - length({found}))', _KINDS['alnum'])})" if words else "false"
    word = f"regexp_extract({near}, '^[{SPACE}]*([{ALPHA}]+)', 1)"
    starter = _in(word, rules.starters)
    if rules.starter_space:
        starter = f"({starter} AND {_like(near, f'^[{SPACE}]*[{ALPHA}]+[{SPACE}]')})"
    return f"""CASE
        WHEN {ends(rules.ellipses)} AND NOT {goes_on} THEN {ellipsis}
        WHEN c = '.' AND prefix(r, '.') THEN false
        WHEN c = '.' AND {initials} THEN false
        WHEN NOT ({_in('c', rules.terminators)}) THEN false
        WHEN {ends([p.pattern for p in config.terminators.patterns])} THEN true
        WHEN {_in('(c || left(r, 1))', rules.pairs_ahead)} THEN false
        WHEN {abbreviated} THEN ({word} = '' OR {starter})
        WHEN c IN ('!', '?', '！', '？') THEN true
        WHEN c IN ('.', '。') THEN NOT ({_like('l', '[0-9]$')} AND {_like('r', '^[0-9]')})
        ELSE false END"""


def _suppressed(rules: Rules) -> str:
    tests = []
    for char, patterns in rules.fast.items():
        for f in patterns:
            test = [f"c = {text_of(char)}"]
            if f.line_start:
                test.append(f"NOT {_like('right(l, 11)', '^[^' + chr(92) + 'n]{11}$')}")
            if f.before is not None:
                test.append(_like("l", _KINDS[f.before] + "$") if f.before in _KINDS else "false")
            if f.after is not None:
                test.append(_like("r", "^" + _KINDS[f.after]) if f.after in _KINDS else "false")
            tests.append("(" + " AND ".join(test) + ")")
    tests += [_like("(right(l, 3) || c || left(r, 3))", _unicode(p.pattern)) for p in rules.config.suppression.regex_patterns]
    return _or(tests)


def events(source: str, language: str | LanguageConfig) -> str:
    """CTEs ending in `ends(key, text, end_char, end_byte)`: accepted sentence ends. source: SQL giving key, text."""
    rules = Rules.of(language)
    special = "".join(map(_re, sorted(rules.judged | set(rules.enclosures))))
    run = "(PARTITION BY key ORDER BY k ROWS UNBOUNDED PRECEDING)"
    outside = []
    for slot in range(rules.n_depths):
        arms = " ".join(f"WHEN {text_of(ch)} THEN {d}" for ch, (sym, at, d) in rules.enclosures.items() if not sym and at == slot)
        outside.append(f"sum(CASE WHEN real THEN CASE c {arms} ELSE 0 END ELSE 0 END) OVER {run} <= 0")
    for slot in {at for sym, at, _ in rules.enclosures.values() if sym}:
        chars = [ch for ch, (sym, at, _) in rules.enclosures.items() if sym and at == slot]
        outside.append(f"sum(CASE WHEN real AND {_in('c', chars)} THEN 1 ELSE 0 END) OVER {run} % 2 = 0")
    return f"""src AS ({source}),
    cut AS (SELECT key, text, regexp_extract_all(text, {text_of(f'(?s)[^{special}]*[{special}]|[^{special}]+')}) AS pieces FROM src WHERE text <> ''),
    pieces AS (SELECT key, text, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM cut),
    placed AS (SELECT key, text, k, right(piece, 1) AS c, sum(length(piece)) OVER {run} AS end_char, sum(strlen(piece)) OVER {run} AS end_byte FROM pieces),
    seen AS (SELECT *, substr(text, greatest(end_char - 31, 1)::BIGINT, (end_char - greatest(end_char - 31, 1))::BIGINT) AS l, substr(text, (end_char + 1)::BIGINT, 32) AS r FROM placed),
    tested AS (SELECT *, {_in('c', rules.enclosures)} AND NOT {_suppressed(rules)} AS real FROM seen),
    summed AS (SELECT *, {' AND '.join(outside) or 'true'} AS outside FROM tested),
    ends AS (SELECT key, text, end_char::BIGINT AS end_char, end_byte::BIGINT AS end_byte FROM summed WHERE outside AND {_in('c', rules.judged)} AND {_judge(rules)})"""


def boundaries(source: str, language: str | LanguageConfig, key: str = "case_id") -> str:
    return f"WITH {events(source, language)} SELECT key AS {key}, end_char AS char_offset, end_byte AS offset FROM ends"


def sentences(source: str, language: str | LanguageConfig, key: str = "case_id", preserve_whitespace: bool = False, columns: str = 'idx, text, start, "end", start_byte, end_byte') -> str:
    raw = "substr(text, start + 1, \"end\" - start)"
    return f"""WITH {events(source, language)},
    stops AS (SELECT key, text, end_char AS "end", end_byte FROM ends UNION SELECT key, text, length(text), strlen(text) FROM src WHERE text <> ''),
    slices AS (SELECT *, lag("end", 1, 0) OVER (PARTITION BY key ORDER BY "end") AS start, lag(end_byte, 1, 0) OVER (PARTITION BY key ORDER BY "end") AS start_byte FROM stops),
    bare AS (SELECT key, start, "end", start_byte, end_byte, {raw} AS raw, regexp_replace({raw}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS bare FROM slices),
    numbered AS (SELECT key, (row_number() OVER (PARTITION BY key ORDER BY "end") - 1)::INTEGER AS idx, {'raw' if preserve_whitespace else 'bare'} AS text, start, "end", start_byte, end_byte FROM bare WHERE bare <> '')
    SELECT key AS {key}, {columns} FROM numbered"""


def stats(source: str, language: str | LanguageConfig, key: str = "doc_id") -> str:
    return f"""WITH {events(source, language)}, n AS (SELECT key, count(*) AS n FROM ends GROUP BY key)
    SELECT src.key AS {key}, coalesce(strlen(text), 0)::BIGINT AS bytes_processed, coalesce(length(text), 0)::BIGINT AS chars_processed, coalesce(n, 0)::BIGINT AS sentence_count,
    CASE WHEN coalesce(n, 0) > 0 THEN (length(text)::DOUBLE / n)::FLOAT ELSE 0::FLOAT END AS avg_sentence_length FROM src LEFT JOIN n ON src.key = n.key"""


def classified(source: str, language: str | LanguageConfig) -> str:
    rules = Rules.of(language)
    special = "".join(map(_re, sorted(rules.judged | set(rules.enclosures))))
    return f"""SELECT CASE WHEN {_in('c', rules.judged & set(rules.enclosures))} THEN 'both' WHEN {_in('c', rules.judged)} THEN 'terminator' ELSE 'enclosure' END AS class, c, count(*) AS n
    FROM (SELECT unnest(regexp_extract_all(text, {text_of(f'[{special}]')})) AS c FROM ({source})) GROUP BY c"""

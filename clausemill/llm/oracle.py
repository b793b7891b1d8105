"""DuckDB SQL for those queries of the subpackage that SQL can express."""

from __future__ import annotations

from clausemill.llm.licenses import TEMPLATES, words_of
from clausemill.llm.secrets import BASE, RULES


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def packing(max_len: int = 2048, buckets: int = 8, token_budget: int = 65536) -> str:
    """The same dynamic program, each layer over all pairs of lengths."""
    layers = []
    for k in range(1, buckets):
        layers.append(f"""l{k} AS MATERIALIZED (SELECT i, min(cost) AS cost, arg_min(ends, cost * 1000000 + j + 1) AS ends FROM (
            SELECT i, cost, -1 AS j, ends FROM l{k - 1}
            UNION ALL SELECT b.i, a.cost + b.n_tokens * (b.many - h.many) - (b.total - h.total), a.i, list_append(a.ends, b.n_tokens::BIGINT)
            FROM l{k - 1} a JOIN h ON h.i = a.i JOIN h b ON b.i > a.i) GROUP BY i)""")
    return f"""WITH t AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents),
    c AS (SELECT doc_id, n, unnest(range(0, greatest(ceil(n / {max_len})::BIGINT, 1)))::INTEGER AS piece FROM t),
    p AS MATERIALIZED (SELECT doc_id, piece, piece::BIGINT * {max_len} AS first_token, least(n - piece * {max_len}, {max_len})::INTEGER AS n_tokens FROM c),
    g AS (SELECT n_tokens, count(*) AS m FROM p GROUP BY n_tokens),
    h AS MATERIALIZED (SELECT n_tokens::BIGINT AS n_tokens, row_number() OVER (ORDER BY n_tokens) AS i, (sum(m) OVER (ORDER BY n_tokens))::BIGINT AS many, (sum(m * n_tokens) OVER (ORDER BY n_tokens))::BIGINT AS total FROM g),
    l0 AS MATERIALIZED (SELECT i, n_tokens * many - total AS cost, [n_tokens] AS ends FROM h),
    {", ".join(layers)},
    best AS (SELECT ends FROM l{buckets - 1} ORDER BY i DESC LIMIT 1),
    b AS (SELECT p.*, len([e FOR e IN ends IF e < n_tokens])::INTEGER AS bucket, ends FROM p, best),
    r AS (SELECT *, ends[bucket + 1]::INTEGER AS bucket_len, row_number() OVER (PARTITION BY bucket ORDER BY md5(doc_id || ':' || piece), n_tokens) - 1 AS place FROM b),
    s AS (SELECT *, greatest(1, {token_budget} // greatest(bucket_len, 1)) AS room FROM r)
    SELECT doc_id, piece, first_token, n_tokens, bucket, bucket_len, (place // room)::BIGINT AS batch, (place % room)::BIGINT AS slot FROM s"""


def warc() -> str:
    bit = "CASE WHEN (instr('0123456789ABCDEF', hex[(p // 4 + 1)::BIGINT]) - 1) & (8 >> (p % 4)::INTEGER) > 0 THEN 1 ELSE 0 END"
    letter = f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum([({bit}) * (16 >> (p % 5)::INTEGER) FOR p IN range(g * 5, g * 5 + 5)])::BIGINT, 1)"
    return f"""WITH s AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, upper(sha1(coalesce(html, ''))) AS hex FROM pages),
    d AS (SELECT *, array_to_string([{letter} FOR g IN range(0, 32)], '') AS payload_digest, min(page_id) OVER (PARTITION BY hex) AS first FROM s)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM d"""


def secrets() -> str:
    parts = [
        f"""SELECT doc_id, {no} AS no, {_text(r.kind)} AS kind, regexp_extract_all(text, {_text(r.find)}) AS ms, regexp_extract_all(text, {_text(r.find)}, {r.group}) AS ps,
        string_split_regex(text, {_text(r.find)}) AS gs, {r.least} AS least FROM docs WHERE regexp_matches(text, {_text(r.find)})"""
        for no, r in enumerate(RULES)
    ]
    counts = ", ".join(f"count(*) FILTER (no = {no}) AS n{no}" for no in range(len(BASE)))
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ({" UNION ALL ".join(parts)}),
    e AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
    f AS (SELECT doc_id, no, kind, list_sum([length(g) FOR g IN gs[1:i]])::BIGINT + coalesce(list_sum([length(x) FOR x IN ms[1:i - 1]]), 0)::BIGINT AS start, length(ms[i]) AS size FROM e WHERE length(ps[i]) >= least),
    s AS (SELECT doc_id, no, start, kind || ':' || start || ':' || (start + size) AS span FROM f),
    a AS (SELECT doc_id, {counts}, coalesce(string_agg(span, ',' ORDER BY start, no) FILTER (no < {len(BASE)}), '') AS base, string_agg(span, ',' ORDER BY start, no) AS spans FROM s GROUP BY doc_id)
    SELECT docs.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM docs LEFT JOIN a ON docs.doc_id = a.doc_id"""


def windows(size: int = 13) -> str:
    return f"""WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    x AS MATERIALIZED (SELECT doc_id, unnest([array_to_string(ws[i:i + {size - 1}], ' ') FOR i IN range(1, len(ws) - {size - 2})]) AS win, unnest(range(1, len(ws) - {size - 2})) AS i FROM w WHERE len(ws) >= {size}),
    low AS (SELECT win, min(doc_id) AS first FROM x GROUP BY win),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {size})) AS at FROM x JOIN low ON x.win = low.win WHERE first < doc_id),
    each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS at FROM w),
    kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.at) AS text, count(*) AS n FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.at = g.at WHERE g.at IS NULL GROUP BY e.doc_id)
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""


def vectors(threshold: float = 0.95) -> str:
    return f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    good AS MATERIALIZED (SELECT * FROM v WHERE len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND list_sum([x * x FOR x IN e]) > 0),
    p AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {threshold}),
    reach AS (SELECT vec_id AS u, vec_id AS v FROM v UNION SELECT reach.u, p.v FROM reach JOIN p ON reach.v = p.u),
    c AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u), n AS (SELECT u, count(*) AS n FROM p GROUP BY u)
    SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c ON v.vec_id = c.u LEFT JOIN n ON v.vec_id = n.u"""


def overlaps(least: int = 13) -> str:
    """The best overlap of each document and item over all diagonals with an equal word; four fifths of it are equal."""
    words = "regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    part = lambda key, table: f"SELECT {key}, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS at, len(ws) AS n FROM (SELECT {key}, {words} AS ws FROM {table})"
    return f"""WITH d AS MATERIALIZED ({part('doc_id', 'documents')}), i AS MATERIALIZED ({part('item_id', 'benchmark')}),
    hit AS MATERIALIZED (SELECT doc_id, item_id, d.at - i.at AS shift, i.at AS q, d.n AS n, i.n AS m FROM d JOIN i ON d.w = i.w),
    diagonal AS MATERIALIZED (SELECT doc_id, item_id, shift, m, count(*) AS equal, shift >= 0 AND shift + m <= n AS whole FROM hit GROUP BY doc_id, item_id, shift, m, n
        HAVING count(*) * 5 >= least(m, {least}) * 4),
    placed AS MATERIALIZED (SELECT doc_id, item_id, shift, q, row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY q) AS r FROM hit SEMI JOIN diagonal USING (doc_id, item_id, shift) WHERE m > {least}),
    stretch AS (SELECT a.doc_id, a.item_id, a.shift, a.q AS start, b.q - a.q + 1 AS size, b.r - a.r + 1 AS equal FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND a.shift = b.shift AND b.q >= a.q + {least - 1}
        WHERE (b.r - a.r + 1) * 5 >= (b.q - a.q + 1) * 4 QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.item_id, a.shift ORDER BY size DESC, b.q) = 1),
    found AS (SELECT * FROM stretch UNION ALL SELECT doc_id, item_id, shift, 0, m, equal FROM diagonal ANTI JOIN stretch USING (doc_id, item_id, shift) WHERE whole AND equal * 5 >= m * 4)
    SELECT doc_id, item_id, (start + shift)::BIGINT AS doc_start, start::BIGINT AS item_start, size::BIGINT AS n_tokens, equal::BIGINT AS n_equal, equal::DOUBLE / size AS similarity FROM found
    QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY size DESC, equal DESC, shift) = 1"""


def licences(support: float = 0.6) -> str:
    """Phrases by position in the list of words; templates by key phrases and the start that most of their words imply."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    base, others = [t for t in TEMPLATES if t.base], [t for t in TEMPLATES if not t.base]
    starts, labels = [], []
    for t in base:
        phrase = words_of(t.text)
        test = " AND ".join(f"ws[i + {k + 1}] = {_text(w)}" for k, w in enumerate(phrase))
        starts.append(f"[i FOR i IN range(0, greatest(len(ws) - {len(phrase) - 1}, 0)) IF {test}]")
        labels.append(t.label)
    keyed = " UNION ALL ".join(f"SELECT doc_id, {_text(t.label)} AS label, {len(words_of(t.text))} AS size FROM t WHERE " + " AND ".join(f"contains(whole, {_text(' ' + ' '.join(words_of(k)) + ' ')})" for k in t.keys) for t in others)
    places = ", ".join(f"({_text(t.label)}, {k}, {_text(w)})" for t in others for k, w in enumerate(words_of(t.text)))
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
    t AS MATERIALIZED (SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' AS whole, {", ".join(f"{x} AS s{i}" for i, x in enumerate(starts))} FROM w),
    keyed AS MATERIALIZED ({keyed}), p(label, k, word) AS (VALUES {places}),
    each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS place FROM t SEMI JOIN keyed USING (doc_id)),
    votes AS (SELECT doc_id, label, size, place - k AS start, count(*) AS n FROM each JOIN p USING (word) JOIN keyed USING (doc_id, label) GROUP BY doc_id, label, size, place - k),
    part AS (SELECT doc_id, label, max(n)::DOUBLE / size AS part FROM votes GROUP BY doc_id, label, size HAVING max(n)::DOUBLE / size >= {support}),
    more AS (SELECT doc_id, list(label) AS found, max(part) AS part FROM part GROUP BY doc_id),
    b AS (SELECT doc_id, len(ws) AS n, list_concat({', '.join(f's{i}' for i in range(len(base)))}) AS s, list_concat({', '.join(f"CASE WHEN len(s{i}) > 0 THEN [{_text(x)}] ELSE [] END" for i, x in enumerate(labels))}) AS base FROM t)
    SELECT b.doc_id, n::BIGINT AS n_words, len(s)::BIGINT AS n_base, list_min(s)::BIGINT AS first_word, list_max(s)::BIGINT AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels, CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(part, 0.0::DOUBLE) END AS score FROM b LEFT JOIN more ON b.doc_id = more.doc_id"""

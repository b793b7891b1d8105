"""Main text of web pages by nearest-URL differencing.

Each page is cut into lines, a line for each block of text. Pages of a host are put in order of their URL path; a page is
paired with the neighbour whose path shares the longer start with its own (ties: the one before). The lines of the two
are aligned by their longest common subsequence, and lines that both share are template and are deleted, unless markup
says that they are article text. Lines that only this page has are kept unless markup says that they are not.

Markup speaks through a role: `article` (inside <article>), `main` (inside <main> or role=main), `furniture` (inside
<nav>, <header> outside the article, <footer>, <aside>, <form>, or parts whose class, id or role names a menu, sidebar,
advert, comments and the like), or `open` (none of these). Of a page the lines of its highest role are its body; an
article with less than a third of the words of a main part that has `PASSAGE` others is a teaser and counts as main. In a main or open body shared
lines are deleted, but for paragraphs and headings of a part (a div, section or list below <body>) in which differencing
finds prose of this page alone. In an article they are kept, since copies of an article are common, but for parts with a name that
says little by itself (legal, notice, follow, ...): such a part is furniture if the neighbour has its lines too.

Copies: a page with the same body is passed over for the next page in order. A neighbour that shares more than half of the
body's prose (lines of `PROSE` words) is a near copy and deletes nothing; the other neighbour then decides. Shared lines of
`PASSAGE` words are passages, not template, and stay.

Cases: null and empty pages, and pages without text, give an empty text; null or odd URLs count as host '' with the URL
as path; copies in a row get the same neighbours; very long pages are aligned in time of lines x lines / 64; repeated rows
each give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.shared import map_arrow, saved

#: Elements by what they mean for text.
BLOCKS = frozenset("address article aside blockquote body br canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg select button".split())
FURNITURE = frozenset("nav footer aside form menu dialog search".split())
CLOSED_BY = {"p": BLOCKS - {"br"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: Names, as a class, id or role, of parts that are no article text wherever they stand.
NAMES = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars sidenav aside widget widgets related recommended recommendations share sharing sharebar newsletter subscribe subscription signup cookie cookies consent gdpr popup paywall comment comments commentlist replies disqus footer toolbar pagination pager complementary contentinfo dialog".split())
#: Names that say it outside an article; inside one they need a neighbour with the same lines.
HINTS = frozenset("social follow notice notices alert modal overlay reply respond discussion search login copyright legal disclaimer toc hidden header masthead topbar top-bar skip".split())
#: What parts are called beside the word that matters: "comment-list" is comments, "notice-board" is no notice.
LAYOUT = frozenset("area bar block bottom box boxes button buttons container content inner item items left link links list listing menu outer panel post posts right section slot thread top unit widget wrap wrapper".split())
#: Parts that hold articles of readers.
READERS = frozenset("comment comments commentlist replies reply respond discussion disqus".split())
#: Lines of so many words are prose; shared lines of so many are repeated passages, not template.
PROSE, PASSAGE = 20, 50
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are parts of a page, and those that are paragraphs in one.
PARTS = frozenset("article aside div footer form header main nav section table ul ol dl".split())
PARAGRAPHS = HEADINGS | frozenset("p blockquote pre li dd dt td th figcaption".split())
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)([^>]*)>)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
ARTICLE, MAIN, OPEN, NAMED_OFF, OFF = 4, 3, 2, 1, 0
#: Added to the role of a line in a part with a name that says little by itself.
HINTED = 16
#: Marks of a line: it is in the body; it stays though the neighbour has it.
BODY, SAFE = 2, 1


def _word(token: str) -> str:
    """The word of a class that says what the part is, or nothing: "side-bar", "ad-slot" and "site-footer" have one."""
    token = token.lower()
    if token in NAMES or token in HINTS:
        return token
    parts = [p for p in re.split(r"[-_]+", token) if p]
    if len(parts) < 2 or parts[0] in ("has", "is", "no", "not", "with", "without"):
        return ""
    if parts[-1] in NAMES or parts[-1] in HINTS:
        return parts[-1]
    if "".join(parts) in NAMES:
        return "".join(parts)
    return parts[0] if parts[0] in NAMES and all(p in LAYOUT or p.isdigit() for p in parts[1:]) else ""


def _named(element: str, attributes: str) -> tuple[str, bool, bool]:
    """What the attributes name a part: a word of NAMES or HINTS or nothing; whether they hide it; whether it is the main part."""
    found, hidden, main = "", False, False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "role") or (name == "id" and element not in HEADINGS):
            for word in map(_word, value.split()):
                if word and found not in NAMES:
                    found = word if word in NAMES or not found else found
        main |= name == "role" and value.lower() == "main"
        hidden |= name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None)
    return found, hidden, main


def lines(page: str) -> list[tuple[int, str]]:
    """(role, text) of each block of text in page order; character references decoded, white space turned into one space."""
    return [(r, t) for r, t, _ in blocks(page)]


def blocks(page: str) -> list[tuple[int, str, int]]:
    """As `lines`, with the number of the part below <body> that holds the block if that is a paragraph, heading or the like, else 0."""
    out: list[tuple[int, str, int]] = []
    run: list[str] = []
    stack: list[tuple[str, int, int]] = []  # open elements, and the role and the part inside each
    role, at, parts = OPEN, 0, 0

    def held() -> int:
        return stack[-1][2] if any(name in PARAGRAPHS for name, _, part in stack if part == stack[-1][2]) else 0

    def close() -> None:
        if run:
            text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
            run.clear()
            if text:
                out.append((role, text, held() if stack and stack[-1][2] else 0))

    while (m := _TAG.search(page, at)) is not None:
        if m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in BLOCKS:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close() if stack[i][1] != (stack[i - 1][1] if i else OPEN) else None
                    del stack[i:]
                    role = stack[-1][1] if stack else OPEN
                    break
            continue
        if name in RAW:  # to its own end, or to the end of the page
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if not (m[3] or m[6] or "").endswith("/") or name not in ("svg", "math"):
                at = end.end() if end else (len(page) if name in ("script", "style", "textarea", "title", "xmp") else at)
            continue
        if name in BLOCKS:
            close()
        while stack and name in CLOSED_BY.get(stack[-1][0], ()):
            stack.pop()
        role = stack[-1][1] if stack else OPEN
        if name in VOID:
            continue
        attributes = (m[3] or m[6] or "").strip(" /")
        word, hidden, main = _named(name, attributes) if attributes and name not in ("body", "html") else ("", False, False)
        inner, inside = role, role & ~HINTED == ARTICLE
        if hidden or name in FURNITURE or (name == "header" and not inside):
            inner = OFF
        elif inside and word in HINTS:
            inner = role | HINTED
        elif word:
            inner = min(role, OFF if word in READERS else NAMED_OFF)
        elif role != OFF and name == "article" and not inside:
            # Names of a layout, as "has-sidebar", do not hide an article; a second one in a named part is no more of it.
            inner = ARTICLE if role != NAMED_OFF or not any(r & ~HINTED == ARTICLE for r, _, _ in out) else role
        elif role in (OPEN, NAMED_OFF) and (name == "main" or main):
            inner = MAIN
        if inner != role:
            close()
        part = stack[-1][2] if stack else 0
        if name in PARTS:
            part = parts = parts + 1
        stack.append((name, inner, part))
        role = inner
    if at < len(page):
        run.append(page[at:])
    close()
    return out


def body_of(found: list[tuple[int, str]]) -> list[bool]:
    """Which lines are of the page's body: those of its highest role; a teaser article belongs to the main part around it."""
    roles = [r & ~HINTED for r, _ in found]
    top = max(roles, default=OFF)
    if top == ARTICLE and MAIN in roles:
        main, article = (sum(t.count(" ") + 1 for r, (_, t) in zip(roles, found, strict=True) if r == x) for x in (MAIN, ARTICLE))
        top = MAIN if main >= PASSAGE and 2 * article < main else ARTICLE
    return [top >= OPEN and r >= top for r in roles]


def place(url: str | None) -> tuple[str, str]:
    """Host and path of a URL, the path without scheme, query and fragment."""
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\s]*)([^?#]*)", url or "")
    return (m[1].rpartition("@")[2].lower(), m[2] or "/") if m else ("", url or "")


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a and each start of b, in bits of long integers, 64 pairs at a time."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every
    for x in a:
        met = row & where.get(x, 0)
        row = ((row + met) | (row - met)) & every
    steps = np.unpackbits(np.frombuffer((row ^ every).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def common_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which lines of `a` are in a longest common subsequence with `b` (hashes of lines).

    Lines that one side lacks are left out, equal starts and ends are taken, and the middle of a is split where the
    halves have most in common, so that memory is linear.
    """
    shared = np.zeros(len(a), bool)
    at, other = np.flatnonzero(np.isin(a, b)), b[np.isin(b, a)].tolist()
    todo = [(at, a[at].tolist(), other)]
    while todo:
        at, x, y = todo.pop()
        lo, most = 0, min(len(x), len(y))
        while lo < most and x[lo] == y[lo]:
            lo += 1
        hi = 0
        while hi < most - lo and x[-1 - hi] == y[-1 - hi]:
            hi += 1
        shared[at[:lo]] = True
        shared[at[len(at) - hi :]] = True
        at, x, y = at[lo : len(at) - hi], x[lo : len(x) - hi], y[lo : len(y) - hi]
        if len(x) == 1:
            shared[at] = x[0] in y
        elif x and y:
            half = len(x) // 2
            j = int((_lengths(x[:half], y) + _lengths(x[:half - 1:-1], y[::-1])[::-1]).argmax())
            todo += [(at[:half], x[:half], y[:j]), (at[half:], x[half:], y[j:])]
    return shared


def _starts_alike(a: str, b: str | None) -> int:
    if b is None:
        return -1
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return n


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url, text, n_chars), a row for each row of pages."""
    kind = pages.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows = []
                for url, page in zip(part.column(url_col).to_pylist(), part.column(html_col).to_pylist(), strict=True):
                    parsed_blocks = blocks(page or "")
                    found = [b[:2] for b in parsed_blocks]
                    host, path = place(url)
                    hashes = np.array([xxhash.xxh64_intdigest(t) for _, t in found], np.uint64)
                    roles = bytes(r for r, _ in found)
                    mine = body_of(found)
                    text = "\n".join(t for (_, t), m in zip(found, mine, strict=True) if m)  # a line has no line feed
                    rows.append((host, path, hashes.tobytes(), bytes(BODY * m + SAFE * (r == ARTICLE) for r, m in zip(roles, mine, strict=True)), np.array([b[2] for b, m in zip(parsed_blocks, mine, strict=True) if m], np.int32).tobytes(), xxhash.xxh64_intdigest(text) >> 1, squeeze.compress(text.encode())))
                if rows:
                    h, p, x, r, c, s, t = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(id_col), part.column(url_col), pa.array(h, pa.string()), pa.array(p, pa.string()), pa.array(x, pa.binary()), pa.array(r, pa.binary()), pa.array(c, pa.binary()), pa.array(s, pa.int64()), pa.array(t, pa.binary())], names=["id", "url", "host", "path", "hashes", "roles", "parts", "sign", "body"])

    parsed = map_arrow(pages.select(id_col, url_col, html_col), cut, f"id {kind}, url string, host string, path string, hashes binary, roles binary, parts binary, sign long, body binary")
    key_columns = ("host", "path", "sign")
    key = F.struct(*key_columns)
    # A page stands for its copies under the same path.
    narrow = parsed.groupBy(*key_columns).agg(F.min("hashes").alias("hashes"))
    ordered = saved(narrow.repartitionByRange(*key_columns).sortWithinPartitions(*key_columns).withColumn("part", F.spark_partition_id()), "page-order")
    seen = F.struct(*key_columns, "hashes")
    ends = ordered.groupBy("part").agg(F.min_by(seen, key).alias("head"), F.max_by(seen, key).alias("tail"))
    # Copies in a row have the same neighbours: on each side the nearest page with another sign.
    sides = ordered
    for side, order, first, last in (("before", [F.asc(c) for c in key_columns], "head", "tail"), ("after", [F.desc(c) for c in key_columns], "tail", "head")):
        run = Window.partitionBy("part").orderBy(*order)
        turn = F.lag(seen).over(run)
        sides = sides.withColumn("turn", F.when(turn["sign"] != F.col("sign"), turn))
        sides = sides.withColumn(side, F.last("turn", True).over(run.rowsBetween(Window.unboundedPreceding, 0))).drop("turn")
        # The same over partitions, a row for each: where the nearest page with another sign than a partition's first is.
        away = ends.join(sides.groupBy("part").agg((F.max_by if side == "before" else F.min_by)(side, key).alias("inner")), "part")
        chain = Window.orderBy(F.asc("part") if side == "before" else F.desc("part"))
        line = away.select("part", F.col(f"{first}.sign").alias("first"), F.col(f"{last}.sign").alias("last"), F.col("inner").isNotNull().alias("turns"))
        line = line.withColumn("prior", F.lag(F.struct("part", F.lit(False).alias("inner"), F.col("last").alias("sign"))).over(chain))
        line = line.withColumn("value", F.when(F.col("turns"), F.struct("part", F.lit(True).alias("inner"))).when(F.col("prior.sign") != F.col("last"), F.struct("prior.part", "prior.inner")))
        line = line.withColumn("beyond", F.last("value", True).over(chain.rowsBetween(Window.unboundedPreceding, -1)))
        line = line.select("part", F.when(F.col("prior.sign") != F.col("first"), F.struct("prior.part", "prior.inner")).otherwise(F.col("beyond")).alias("from"))
        source = away.select(F.col("part").alias("source"), "inner", F.col(last).alias("end"))
        linked = line.join(source, F.col("from.part") == F.col("source")).select("part", F.when(F.col("from.inner"), F.col("inner")).otherwise(F.col("end")).alias("outer"))
        sides = sides.join(linked, "part", "left").withColumn(side, F.coalesce(side, "outer")).drop("outer")
    near = sides.select("host", "path", "sign", "before", "after")

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [main_text(*row) for row in zip(*(part.column(c).to_pylist() for c in ("host", "path", "hashes", "roles", "parts", "body", "before", "after")), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[id_col, "url", "text", "n_chars"])

    joined = parsed.join(near, ["host", "path", "sign"], "left")
    return map_arrow(joined.select("id", "url", "host", "path", "hashes", "roles", "parts", "body", "before", "after"), difference, f"`{id_col}` {kind}, url string, text string, n_chars long")


def main_text(host: str, path: str, hashes: bytes, flags: bytes, parts: bytes, body: bytes, before: dict | None, after: dict | None) -> str:
    """The lines of the body that are left, joined by one space; flags has a byte for each line of the page, parts a number for each of the body."""
    texts = zstandard.ZstdDecompressor().decompress(body).decode().split("\n")
    kept = np.ones(len(texts), bool)
    flag, own = np.frombuffer(flags, np.uint8), np.frombuffer(hashes, np.uint64)
    mine = flag & BODY > 0
    if not mine.any():
        return ""
    safe = flag[mine] & SAFE > 0
    near = sorted((x for x in (before, after) if x and x["host"] == host), key=lambda x: -_starts_alike(path, x["path"]))
    size, words = np.array(list(map(len, texts))), np.array([t.count(" ") + 1 for t in texts])
    prose, passage = words >= PROSE, words >= PASSAGE
    for other in near if not safe.all() else []:
        shared = common_lines(own, np.frombuffer(other["hashes"], np.uint64))[mine]
        if 2 * size[shared & prose].sum() > size[prose].sum():  # a near copy
            continue
        part = np.frombuffer(parts, np.int32)
        kept = safe | passage | ~shared | (part > 0) & np.isin(part, part[prose & ~shared])
        break
    return " ".join(t for t, k in zip(texts, kept, strict=True) if k)

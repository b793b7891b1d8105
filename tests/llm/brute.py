"""Plain versions of the operators, written from their definitions."""

import base64
import hashlib
import re

import numpy as np
import xxhash

LOWER = {i: i + 32 for i in range(65, 91)}
SPACE_WORD, LICENCE_WORD = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def components(ids, linked):
    """Smallest id reachable from each; linked: pairs."""
    at = {i: i for i in ids}

    def root(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def fingerprint(text, shingle=3):
    words = SPACE_WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def licence_base(text):
    words = LICENCE_WORD.findall((text or "").translate(LOWER))
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        here = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += here
        labels |= {label} if here else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)


def secret_base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]


def windows(rows, size=13):
    """(n_words, n_removed, sha256) of each (id, text)."""
    low = {}
    split = [(i, SPACE_WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - size + 1 if i is not None else 0):
            key = tuple(w[k : k + size])
            low[key] = min(low.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1 if i is not None else 0):
            if low[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def vectors(rows, threshold=0.95):
    good = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and len(v) and np.isfinite(np.array(v, float)).all() and np.linalg.norm(np.array(v, float)) > 0}
    ids, n, linked = [i for i, _ in rows], dict.fromkeys([i for i, _ in rows], 0), []
    for a, x in good.items():
        for b, y in good.items():
            if a < b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                n[a] += 1
                n[b] += 1
                linked.append((a, b))
    component = components(ids, linked)
    return sorted((i, n[i], component[i], component[i] == i) for i in ids)


def sha1_base32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def padding(lengths, counts, ends):
    return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts, strict=True))


def decontaminated(rows, items, similarity=(4, 5), least=13):
    """(doc, item, doc_start, item_start, n_tokens, n_equal) of the best overlap of each text and item, over all diagonals."""
    up, down = similarity
    split = lambda t: LICENCE_WORD.findall((t or "").lower())
    out = []
    for d, text in rows:
        t = split(text)
        for i, item in items:
            q = split(item)
            best = None
            for shift in range(-len(q) + 1, len(t)):
                lo, hi = max(0, -shift), min(len(q), len(t) - shift)
                same = [q[k] == t[k + shift] for k in range(lo, hi)]
                if down * sum(same) < up * min(least, len(q)):
                    continue
                whole = hi - lo == len(q)
                found = []
                if len(q) > least:
                    spans = [(b - a, -b, a) for a in range(len(same)) for b in range(a + least, len(same) + 1) if same[a] and same[b - 1] and down * sum(same[a:b]) >= up * (b - a)]
                    if spans:
                        n, end, a = max(spans)
                        found = [(n, sum(same[a : a + n]), -shift, lo + a)]
                if not found and whole and q and down * sum(same) >= up * len(q):
                    found = [(len(q), sum(same), -shift, 0)]
                best = max([best, *found] if best else found, default=None)
            if best:
                n, equal, back, start = best
                out.append((d, i, start - back, start, n, equal))
    return sorted(out)

"""Compiled rules and the scan of one text, in Python, for executors' Arrow batches and for single texts.

Each special character is judged from the characters around it alone. Depths and parities are running sums, so a scan of
part of a text gives a `State` with sums relative to its start, and states of neighbouring parts add up.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

import regex

from clausemill.config import REACH, LanguageConfig, bundled, checked
from clausemill.errors import ConfigurationError

#: Reaches in characters, or bytes for the last.
NEAR, ABBREVIATION, LINE, ENCLOSURE, SLICE_BYTES = 10, 21, 11, 3, 20
_DIGITS = frozenset("0123456789")
STRONG, WEAK, NO = 2, 1, 0
_ALPHABETIC, _ALNUM, _SPACE, _UPPER, _LOWER = 1, 2, 4, 8, 16


class _Kinds(dict):
    """Unicode properties of a character, looked up once."""

    _of = [(_ALPHABETIC, regex.compile(r"\p{Alphabetic}")), (_ALNUM, regex.compile(r"[\p{Alphabetic}\p{N}]")), (_SPACE, regex.compile(r"\p{White_Space}")), (_UPPER, regex.compile(r"\p{Uppercase}")), (_LOWER, regex.compile(r"\p{Lowercase}"))]

    def __missing__(self, c: str) -> int:
        self[c] = kind = sum(bit for bit, p in self._of if p.match(c))
        return kind


KIND = _Kinds()
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trimmed(text: str) -> str:
    """Without Unicode white space at either end."""
    return text.strip(_SPACES)


def _lowered(text: str) -> str:
    """Each character by the first of its lower-case form; whole strings differ where that has two or depends on its place."""
    low = text.lower()
    return low if len(low) == len(text) and "Σ" not in text else "".join(c.lower()[:1] for c in text)


@dataclass
class State:
    """What a part of a text adds: (place after it, depths, parity, strength) of each positive terminator, and sums."""

    candidates: list[tuple[int, tuple[int, ...], int, int]] = field(default_factory=list)
    depths: tuple[int, ...] = ()
    parity: int = 0
    size: int = 0

    def then(self, other: State) -> State:
        moved = [(self.size + at, tuple(map(int.__add__, self.depths, d)), self.parity ^ p, s) for at, d, p, s in other.candidates]
        return State(self.candidates + moved, tuple(map(int.__add__, self.depths, other.depths)), self.parity ^ other.parity, self.size + other.size)

    def boundaries(self) -> list[int]:
        return [at for at, d, p, _ in self.candidates if not p and (not d or max(d) <= 0)]


class Rules:
    def __init__(self, config: LanguageConfig):
        self.config = config
        chars = [c[0] for c in config.terminators.chars if c]
        patterns = [p.pattern for p in config.terminators.patterns if p.pattern]
        self.ellipses = [p for p in config.ellipsis.patterns if p]
        longest = max(map(len, patterns + self.ellipses), default=0)
        if longest >= REACH:
            raise ConfigurationError(f"a pattern of {longest} characters does not fit into the window of {REACH}")
        self.ellipsis_ends, self.pattern_ends = tuple(self.ellipses), tuple(patterns)
        self.terminators = frozenset(chars)
        self.pairs_ahead = frozenset(p for p in patterns if len(p) == 2)
        self.judged = frozenset("".join([*chars, *patterns, *self.ellipses]))
        self.enclosures: dict[str, tuple[bool, int, int]] = {}  # (symmetric, slot, delta)
        asymmetric = symmetric = 0
        for pair in config.enclosures.pairs:
            a, b = pair.open[:1], pair.close[:1]
            if not a or not b:
                continue
            if pair.symmetric:
                if symmetric >= 32:
                    raise ConfigurationError("more than 32 symmetric enclosures")
                self.enclosures |= {a: (True, symmetric, 0), b: (True, symmetric, 0)}
                symmetric += 1
            else:
                self.enclosures[a] = (False, asymmetric, 1)
                self.enclosures[b] = (False, asymmetric, -1)
                asymmetric += 1
        self.n_depths = asymmetric
        self.fast: dict[str, list] = {}
        for f in config.suppression.fast_patterns:
            if f.char:
                self.fast.setdefault(f.char[0], []).append(f)
        self.suppressions = _joined([p.pattern for p in config.suppression.regex_patterns])
        self.exceptions = [(checked(e.regex), e.boundary) for e in config.ellipsis.exceptions]
        words = [w for w in config.abbreviations.words() if w]
        self.abbreviations = frozenset(_lowered(w) for w in words if len(w) <= ABBREVIATION)
        self.lengths = sorted({len(w) for w in self.abbreviations}, reverse=True)
        self.tails = frozenset(w[-2:] for w in self.abbreviations)
        self.ends_in_three = frozenset(w[-3:] for w in self.abbreviations if len(w) > 2)  # shorter ones begin no word after a letter
        self.longest = self.lengths[0] if self.lengths else 0
        self.usual = self._usual()
        starters = config.sentence_starters
        least = starters.min_word_length if starters else 1
        self.starters = frozenset(w for w in (starters.words() if starters else ()) if len(w.encode()) >= least)
        self.starter_space = starters.require_following_space if starters else True
        self.special = re.compile("[" + "".join(map(re.escape, sorted(self.judged | set(self.enclosures)))) + "]")
        self.run_continues = [(q[:i], q[i:]) for q in self.ellipses for i in range(len(q))]

    @classmethod
    def of(cls, language: str | LanguageConfig) -> Rules:
        return cls(bundled(language) if isinstance(language, str) else language)

    @cached_property
    def zero(self) -> tuple[int, ...]:
        return (0,) * self.n_depths

    def _usual(self) -> dict[str, tuple[int, frozenset[str]]]:
        """Marks whose judgment after three ASCII letters follows from the next character, if no abbreviation may end there.

        For each its strength and the next characters that need the whole judge. A mark is not among them if a longer
        pattern could end with it after a letter.
        """
        out = {}
        for c in self.terminators & set(".。!?！？"):
            if not any(p[-1] == c and (len(p) == 1 or p[-2].isalpha()) for p in (*self.ellipses, *self.pattern_ends)):
                out[c] = (WEAK if c in ".。" else STRONG, frozenset({p[1] for p in self.pairs_ahead if p[0] == c} | ({"."} if c == "." else set())))
        return out

    # The judge

    def judge(self, text: str, at: int) -> int:
        """Strength of the terminator before place `at` of `text`."""
        c = text[at - 1]
        low = max(0, at - REACH)
        if text.endswith(self.ellipsis_ends, low, at) and self._run_stops(text, at, low):
            return self._ellipsis(text, at, low)
        after = text[at : at + NEAR]
        if c == ".":
            if after[:1] == ".":
                return NO
            if after and self._initials(text, at, low, after):
                return NO
        if c not in self.terminators:
            return NO
        if text.endswith(self.pattern_ends, low, at):
            return STRONG
        if self.pairs_ahead and text[at - 1 : at + 1] in self.pairs_ahead:
            return NO
        if self._abbreviation(text, at - 1, low):
            return self._after_abbreviation(after)
        if c in "!?！？":
            return STRONG
        if c in ".。":
            return NO if after[:1] in _DIGITS and at >= 2 and text[at - 2] in _DIGITS else WEAK
        return NO

    def _run_stops(self, text: str, at: int, low: int) -> bool:
        """No pattern occurrence that overlaps or starts at this place ends beyond it."""
        return not any(text.startswith(b, at) and text.endswith(a, low, at) for a, b in self.run_continues)

    def _ellipsis(self, text: str, at: int, low: int) -> int:
        if self.exceptions:
            before, after = text[low : at - 1], text[at - 1 : at + REACH]
            piece = _tail(before, SLICE_BYTES) + _head(after, SLICE_BYTES)
            for pattern, boundary in self.exceptions:
                if pattern.search(piece):
                    return WEAK if boundary else NO
        first = next((c for c in text[at : at + NEAR] if KIND[c] & _ALPHABETIC), None)
        for rule in self.config.ellipsis.context_rules:
            bit = {"followed_by_capital": _UPPER, "followed_by_lowercase": _LOWER}.get(rule.condition, 0)
            if first is not None and KIND[first] & bit:
                return WEAK if rule.boundary else NO
        return WEAK if self.config.ellipsis.treat_as_boundary else NO

    def _initials(self, text: str, at: int, low: int, after: str) -> bool:
        """One or two letters before the period, and again before another after it."""
        n, i = 0, at - 2
        while i >= low and i >= at - 1 - NEAR and KIND[text[i]] & _ALPHABETIC:
            n, i = n + 1, i - 1
            if n > 2:
                return False
        if not n:
            return False
        i = 0
        while i < len(after) and KIND[after[i]] & _SPACE:
            i += 1
        n = 0
        while i < len(after) and n < 3 and KIND[after[i]] & _ALPHABETIC:
            i, n = i + 1, n + 1
        return 0 < n <= 2 and after[i : i + 1] == "."

    def _abbreviation(self, text: str, end: int, low: int) -> bool:
        """Whether the longest abbreviation that ends at `end` begins a word."""
        two = _lowered(text[max(low, end - 2) : end])
        if two not in self.tails and two[-1:] not in self.tails:
            return False
        back = _lowered(text[max(low, end - self.longest) : end])
        for n in self.lengths:
            if n <= len(back) and back[-n:] in self.abbreviations:
                return end - n <= low or not KIND[text[end - n - 1]] & _ALNUM
        return False

    def _after_abbreviation(self, after: str) -> int:
        rest = after.lstrip(_SPACES)
        n = 0
        while n < len(rest) and KIND[rest[n]] & _ALPHABETIC:
            n += 1
        if not n:
            return WEAK
        if rest[:n] not in self.starters:
            return NO
        return WEAK if not self.starter_space or (n < len(rest) and KIND[rest[n]] & _SPACE) else NO

    # Enclosures

    def suppressed(self, text: str, at: int) -> bool:
        """Whether the enclosure character at place `at` is none."""
        c = text[at]
        for f in self.fast.get(c, ()):
            if f.line_start:
                back = text[max(0, at - LINE) : at]
                if len(back) == LINE and "\n" not in back:
                    continue
            if f.before is not None and not _is(text[at - 1] if at else "", f.before):
                continue
            if f.after is not None and not _is(text[at + 1 : at + 2], f.after):
                continue
            return True
        if self.suppressions:
            window = text[max(0, at - ENCLOSURE) : at + ENCLOSURE + 1]
            return any(p.search(window) for p in self.suppressions)
        return False

    def scan(self, text: str, first: int = 0, end: int | None = None) -> State:
        """The state of text[first:end]; what stands around it in `text` is only looked at."""
        end = len(text) if end is None else end
        depths, parity = list(self.zero), 0
        now = self.zero
        out = []
        enclosures, judged, judge, usual, tails = self.enclosures, self.judged, self.judge, self.usual, self.ends_in_three
        for m in self.special.finditer(text, first, end):
            at = m.start()
            c = text[at]
            slot = enclosures.get(c)
            if slot is not None and not self.suppressed(text, at):
                if slot[0]:
                    parity ^= 1 << slot[1]
                else:
                    depths[slot[1]] += slot[2]
                    now = tuple(depths)
            if c in judged:
                word = text[at - 3 : at] if at > 2 and c in usual else ""
                if word and word.isalpha() and word.isascii() and text[at + 1 : at + 2] not in usual[c][1] and word.lower() not in tails:
                    strength = usual[c][0]
                else:
                    strength = judge(text, at + 1)
                if strength:
                    out.append((at + 1 - first, now, parity, strength))
        return State(out, now, parity, end - first)

    def scan_parts(self, text: str, size: int, threads: int = 1) -> State:
        """The state of the text from parts of `size` characters, `threads` scanned at once; the same as of one scan."""
        parts = [(a, min(a + size, len(text))) for a in range(0, len(text), size)]
        if threads > 1 and len(parts) > 1:
            with ThreadPoolExecutor(threads) as pool:
                states = list(pool.map(lambda p: self.scan(text, *p), parts))
        else:
            states = [self.scan(text, a, b) for a, b in parts]
        depths, parity, found = self.zero, 0, []
        for (a, _), s in zip(parts, states, strict=True):
            found += [(a + at, tuple(map(int.__add__, depths, d)), parity ^ p, x) for at, d, p, x in s.candidates]
            depths, parity = tuple(map(int.__add__, depths, s.depths)), parity ^ s.parity
        return State(found, depths, parity, len(text))

    def boundaries(self, text: str) -> list[int]:
        """Places after sentence ends, in characters."""
        return self.scan(text).boundaries()

    def slices(self, text: str, preserve_whitespace: bool = False, ends: list[int] | None = None) -> list[tuple[int, int, str]]:
        """(start, end, text) of the sentences and of an unterminated rest; blank ones are left out. `ends` if already known."""
        out, start = [], 0
        for end in [*(self.boundaries(text) if ends is None else ends), len(text)]:
            piece = text[start:end]
            bare = trimmed(piece)
            if bare:
                out.append((start, end, piece if preserve_whitespace else bare))
            start = end
        return out


def _is(c: str, kind: str) -> bool:
    if not c:
        return False
    if kind == "digit":
        return c in "0123456789"
    return bool(KIND[c] & {"alpha": _ALPHABETIC, "alnum": _ALNUM, "whitespace": _SPACE}.get(kind, 0))


def _joined(patterns: list[str]) -> list:
    """The patterns as one alternative, or one by one if they cannot stand together."""
    alone = [checked(p) for p in patterns]
    if any("(?" in p.replace("(?:", "") or re.search(r"\\[1-9gk]", p) for p in patterns):  # flags, names or references
        return alone
    return [checked("|".join(f"(?:{p})" for p in patterns))] if patterns else []


def _tail(text: str, size: int) -> str:
    """The last `size` bytes, from the start of the character that they begin in."""
    raw = text[-size:].encode()
    cut = len(raw) - size
    if cut <= 0:
        return text[-size:]
    while raw[cut] & 0xC0 == 0x80:
        cut -= 1
    return raw[cut:].decode()


def _head(text: str, size: int) -> str:
    """The first `size` bytes, to the end of the character that they end in."""
    raw, cut = text[:size].encode(), size
    while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
        cut += 1
    return raw[:cut].decode()

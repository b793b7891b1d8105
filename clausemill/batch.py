"""The scan of many texts at once, as numpy arrays over their characters.

All special characters of a batch are found in one pass. Usual marks are judged as arrays, from the three letters before
and the character after; the judge of `kernel` sees only the others, with the characters around them. Depths and parities
are running sums over the batch, less what they are where a text begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from clausemill.config import REACH
from clausemill.kernel import _ALNUM, _SPACES, KIND, Rules, _lowered, trimmed

_LETTER = np.zeros(128, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Texts are taken in runs of so many bytes, or one longer text.
RUN_BYTES = 2_000_000


def _table(chars, least: int = 256) -> np.ndarray:
    """Which code points are among `chars`; the last entry stands for all beyond."""
    out = np.zeros(max([least, *(ord(c) + 2 for c in chars)]), bool)
    out[[ord(c) for c in chars]] = True
    return out


_SPACE, _DIGIT = _table(_SPACES), _table("0123456789")
#: ASCII letters; the last entry stands for all code points from 128 on.
_LETTER_OR_NOT = np.append(_LETTER, False)
#: Stands for the character beyond a text's end: no code point.
_NONE = 0x110000
#: Letters that a code of a word holds, five bits each.
_CODED = 12


def _code(word: str) -> int:
    return sum((ord(c) & 31) << 5 * i for i, c in enumerate(reversed(word.lower())))


def look_up(table: np.ndarray, points: np.ndarray) -> np.ndarray:
    return table[points] if points.dtype == np.uint8 else table[np.minimum(points, len(table) - 1)]


def runs(batch: pa.RecordBatch, column: str, most: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows with about `most` bytes of text."""
    texts = batch.column(column)
    sizes = np.cumsum(np.array(pc.binary_length(texts).fill_null(0), np.int64))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


class Texts:
    """Texts joined, their code points and where each begins; a null counts as empty."""

    def __init__(self, texts: pa.Array):
        wide = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        wide = wide.fill_null("") if wide.null_count else wide
        offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
        data = wide.buffers()[2] if len(wide) else None
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.byte_first = offsets - offsets[0]
        self.joined = self.data.tobytes().decode()
        self.is_ascii = len(self.joined) == len(self.data)
        if self.is_ascii:
            self.points, self.first = self.data, self.byte_first
        else:
            self.points = np.frombuffer(self.joined.encode("utf-32-le"), "<u4")
            self.head = np.append(np.flatnonzero((self.data & 0xC0) != 0x80), len(self.data))  # the byte where each character begins
            self.first = np.searchsorted(self.head, self.byte_first)

    def __len__(self) -> int:
        return len(self.first) - 1

    def bytes_of(self, places: np.ndarray) -> np.ndarray:
        return places if self.is_ascii else self.head[places]

    def row_of(self, places: np.ndarray) -> np.ndarray:
        """The text of the character before each place."""
        return np.searchsorted(self.first, places, side="left") - 1


class Scanner:
    def __init__(self, rules: Rules):
        self.rules = rules
        self.special = _table(rules.judged | set(rules.enclosures))
        self.judged, self.enclosing = _table(rules.judged), _table(rules.enclosures)
        runs_ = [p for p in (*rules.ellipses, *rules.pattern_ends) if len(p) > 1]
        #: Mark, strength, characters behind it and before it that need the judge.
        self.usual = [(ord(c), strength, _table(ahead), _table([p[-2] for p in runs_ if p[-1] == c])) for c, (strength, ahead) in sorted(rules.usual.items())]
        words = rules.abbreviations
        self.last = frozenset(w[-1] for w in words)
        #: Codes of abbreviations of ASCII letters; a word between white space is one or has none at its end.
        self.codes = np.array(sorted({_code(w) for w in words if w.isascii() and w.isalpha() and len(w) <= _CODED}), np.int64)
        self.by_words = not any(c in _SPACES for w in words for c in w)
        #: No abbreviation has a letter beyond ASCII or a digit right before its last ASCII letters.
        self.by_ends = not any(KIND[bare[-1]] & _ALNUM for w in words if (bare := w.rstrip(ascii_letters)) and bare != w)
        self.tails = np.zeros(1 << 15, bool)
        for w in rules.ends_in_three:
            if w.isascii() and w.isalpha():
                self.tails[_code(w)] = True

    def ends(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(place after it in the joined texts, strength) of every sentence end, ascending."""
        at = np.flatnonzero(look_up(self.special, t.points))
        if not len(at):
            return at, np.zeros(0, np.int8)
        points = t.points[at]
        marks = at[look_up(self.judged, points)]
        strength = self.judge(t, marks)
        marks, strength = marks[strength > 0], strength[strength > 0]
        around = at[look_up(self.enclosing, points)]
        if len(around) and len(marks):
            outside = self.outside(t, around, marks)
            marks, strength = marks[outside], strength[outside]
        return marks + 1, strength

    def judge(self, t: Texts, marks: np.ndarray) -> np.ndarray:
        """Strength of each mark: by arrays where its neighbours settle it, else by the judge."""
        out = np.zeros(len(marks), np.int8)
        row = t.row_of(marks + 1)
        low, high = t.first[row], t.first[row + 1]
        at = lambda place, some: np.where((place >= low[some]) & (place < high[some]), t.points[np.clip(place, 0, len(t.points) - 1)], _NONE).astype(np.int64)
        every = slice(None)
        back = [at(marks - k, every) for k in (1, 2, 3)]
        ahead = at(marks + 1, every)
        plain = np.zeros(len(marks), bool)
        for c, _, stops, runs_ in self.usual:
            plain |= (t.points[marks] == c) & ~look_up(stops, ahead) & ~look_up(runs_, back[0])
        letter = [look_up(_LETTER_OR_NOT, x) for x in back]
        three = letter[0] & letter[1] & letter[2]
        code = (back[2] & 31) << 10 | (back[1] & 31) << 5 | (back[0] & 31)
        #: Nothing before the mark is an abbreviation: by the last letter, the last three letters, or the whole word.
        free = ~self._may_end(back[0]) | (three & ~self.tails[np.where(three, code, 0)])
        todo = np.flatnonzero(plain & ~free & letter[0])
        free[todo] = self._is_other_word(t, at, marks, todo)
        # Initials: one or two letters, and a period one or two places behind one space.
        dot = t.points[marks] == ord(".")
        near = [at(marks + k, every) for k in (2, 3, 4)]
        spaced = look_up(_SPACE, ahead) & ~look_up(_SPACE, near[0]) & (near[1] != ord(".")) & (near[2] != ord("."))
        spaced |= (ahead < 128) & ~look_up(_LETTER_OR_NOT, ahead) & ~look_up(_SPACE, ahead)
        digit = look_up(_DIGIT, back[0])
        initials = dot & ~three & ~spaced & ~digit & (ahead != _NONE) & (letter[0] | (back[0] > 127))
        decided = plain & free & ~initials
        for c, strength, _, _ in self.usual:
            mine = decided & (t.points[marks] == c)
            out[mine] = strength
            if chr(c) in ".。":
                out[mine & digit & look_up(_DIGIT, ahead)] = 0
        text, judge = t.joined, self.rules.judge
        todo = np.flatnonzero(~decided)
        a, b = np.maximum(marks[todo] - REACH + 1, low[todo]), np.minimum(marks[todo] + 1 + REACH, high[todo])
        for i, m, x, y in zip(todo.tolist(), marks[todo].tolist(), a.tolist(), b.tolist(), strict=True):
            out[i] = judge(text[x:y], m + 1 - x)
        return out

    def _may_end(self, points: np.ndarray) -> np.ndarray:
        """Which characters may end an abbreviation."""
        out = np.zeros(len(points), bool)
        for p in np.unique(points).tolist():
            if p != _NONE and _lowered(chr(p)) in self.last:
                out |= points == p
        return out

    def _alnum(self, points: np.ndarray) -> np.ndarray:
        out = look_up(_DIGIT, points)
        for p in np.unique(points[(points > 127) & (points != _NONE)]).tolist():
            if KIND[chr(p)] & _ALNUM:
                out |= points == p
        return out

    def _is_other_word(self, t: Texts, at, marks: np.ndarray, todo: np.ndarray) -> np.ndarray:
        """Which marks stand behind a word of ASCII letters between white space that is no abbreviation, or in such a word."""
        out = np.zeros(len(todo), bool)
        if not self.by_words:
            return out
        code, left = np.zeros(len(todo), np.int64), np.arange(len(todo))
        for k in range(1, _CODED + 2):
            some = todo[left]
            before = at(marks[some] - k, some)
            inside = look_up(_LETTER_OR_NOT, before)
            over = left[~inside & ((before == _NONE) | look_up(_SPACE, before))]
            spot = np.searchsorted(self.codes, code[over])
            known = spot < len(self.codes)
            known[known] = self.codes[spot[known]] == code[over][known]
            out[over] = ~known
            # A suffix of a longer word begins no word.
            if self.by_ends:
                out[left[~inside & self._alnum(before)]] = True
            left, before = left[inside], before[inside]
            if not len(left) or k > _CODED:
                break
            code[left] |= (before & 31) << 5 * (k - 1)
        return out

    def real(self, t: Texts, around: np.ndarray) -> np.ndarray:
        """Those places of enclosing characters that are not suppressed."""
        row = t.row_of(around + 1)
        a, b = np.maximum(around - REACH, t.first[row]), np.minimum(around + 1 + REACH, t.first[row + 1])
        text, hidden = t.joined, self.rules.suppressed
        kept = np.fromiter((not hidden(text[x:y], m - x) for m, x, y in zip(around.tolist(), a.tolist(), b.tolist(), strict=True)), bool, len(around))
        return around[kept]

    def steps(self, t: Texts, around: np.ndarray) -> Iterator[tuple[bool, int, np.ndarray]]:
        """For each slot whether it is symmetric, its number and the sums before each of `around` and after the last."""
        chars = t.points[around]
        for symmetric in (True, False):
            for slot in sorted({s for sym, s, _ in self.rules.enclosures.values() if sym == symmetric}):
                step = np.zeros(len(around) + 1, np.int64)
                for c, (sym, s, delta) in self.rules.enclosures.items():
                    if (sym, s) == (symmetric, slot):
                        step[1:][chars == ord(c)] = 1 if symmetric else delta
                yield symmetric, slot, np.cumsum(step)

    def outside(self, t: Texts, around: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Which marks stand outside every enclosure of their text."""
        around = self.real(t, around)
        before = np.searchsorted(around, marks, side="right")  # a mark that encloses too counts for itself
        start = np.searchsorted(around, t.first[t.row_of(marks + 1)])
        out = np.ones(len(marks), bool)
        for symmetric, _, total in self.steps(t, around):
            held = total[before] - total[start]
            out &= held % 2 == 0 if symmetric else held <= 0
        return out

    def states(self, t: Texts, low: np.ndarray, high: np.ndarray) -> States:
        """What the part low..high of each text adds; what stands around it is only looked at."""
        at = np.flatnonzero(look_up(self.special, t.points))
        row = t.row_of(at + 1)
        at = at[(at >= low[row]) & (at < high[row])]
        points = t.points[at]
        marks = at[look_up(self.judged, points)]
        marks = marks[self.judge(t, marks) > 0]
        around = self.real(t, at[look_up(self.enclosing, points)])
        row = t.row_of(marks + 1)
        before, start = np.searchsorted(around, marks, side="right"), np.searchsorted(around, low)
        end = np.searchsorted(around, high)
        out = States(marks + 1, row, np.zeros((len(marks), self.rules.n_depths), np.int32), np.zeros(len(marks), np.int64), np.zeros((len(t), self.rules.n_depths), np.int32), np.zeros(len(t), np.int64))
        for symmetric, slot, total in self.steps(t, around):
            each, whole = total[before] - total[start[row]], total[end] - total[start]
            if symmetric:
                out.parity |= each % 2 << slot
                out.last_parity |= whole % 2 << slot
            else:
                out.depths[:, slot], out.last_depths[:, slot] = each, whole
        return out

    def slices(self, t: Texts, preserve_whitespace: bool = False) -> Slices:
        return Slices(t, self.ends(t)[0], preserve_whitespace)


@dataclass
class States:
    """Positive marks, their texts, depths and parities from the start of the part; and these sums at its end for each text."""

    places: np.ndarray
    row: np.ndarray
    depths: np.ndarray
    parity: np.ndarray
    last_depths: np.ndarray
    last_parity: np.ndarray


class Slices:
    """The sentences of some texts and their unterminated rests, blank ones left out."""

    def __init__(self, t: Texts, ends: np.ndarray, preserve_whitespace: bool):
        self.t = t
        cuts = np.sort(np.concatenate([ends, t.first[1:][np.diff(t.first) > 0]]), kind="stable").astype(np.int64)
        cuts = cuts[np.diff(cuts, prepend=-1) > 0]
        start = np.concatenate([[0], cuts[:-1]]).astype(np.int64) if len(cuts) else cuts
        a, b = self._bare(t, start.copy(), cuts.copy())
        full = np.flatnonzero(a < b)
        self.start, self.end = start[full], cuts[full]
        self.a, self.b = (self.start, self.end) if preserve_whitespace else (a[full], b[full])
        self.row = t.row_of(self.end)

    @staticmethod
    def _bare(t: Texts, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places without white space at either end; long runs of it are left to the string."""
        todo = np.arange(len(a))
        for _ in range(8):
            todo = todo[a[todo] < b[todo]]
            todo = todo[look_up(_SPACE, t.points[a[todo]])]
            a[todo] += 1
        back = np.arange(len(a))
        for _ in range(8):
            back = back[a[back] < b[back]]
            back = back[look_up(_SPACE, t.points[b[back] - 1])]
            b[back] -= 1
        for i in {*todo.tolist(), *back.tolist()}:
            piece = t.joined[a[i] : b[i]]
            left = len(piece) - len(piece.lstrip(_SPACES))
            a[i], b[i] = a[i] + left, a[i] + left + len(trimmed(piece))
        return a, b

    def __len__(self) -> int:
        return len(self.row)

    @cached_property
    def idx(self) -> np.ndarray:
        """The number of each in its text."""
        n = np.arange(len(self.row))
        return n - np.searchsorted(self.row, self.row)

    @property
    def text(self) -> pa.Array:
        """Their texts, cut from the bytes without a string for each."""
        a, b = self.t.bytes_of(self.a), self.t.bytes_of(self.b)
        offsets = np.concatenate([[0], np.cumsum(b - a)])
        kept = np.zeros(len(self.t.data) + 1, np.int8)
        kept[a] += 1  # both are ascending, without repeats
        kept[b] -= 1
        data = self.t.data[np.cumsum(kept[:-1], dtype=np.int8) > 0]
        return pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())

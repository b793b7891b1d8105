"""Single texts from Python: split, iter_split, split_large_file, load and SentenceSplitter."""

from __future__ import annotations

import codecs
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame

from clausemill.config import REACH, LanguageConfig, bundled, resolve_code, supported_languages
from clausemill.errors import ConfigurationError, InvalidLanguageError
from clausemill.kernel import Rules, trimmed
from clausemill.sources.readers import ENCODINGS, stream_text_of, text_of

MODES = ("sequential", "parallel", "adaptive")
#: Names that the functions of this module take; the configuration layer knows a few more.
_NAMES = {"en": "en", "english": "en", "ja": "ja", "japanese": "ja"}


@dataclass
class Sentence:
    """start and end are places in characters; start counts white space that `text` is trimmed of."""

    text: str
    start: int
    end: int
    confidence: float = 1.0
    metadata: dict[str, Any] = field(default_factory=dict)

    def __str__(self) -> str:
        return self.text


@dataclass
class ProcessingMetadata:
    total_sentences: int
    processing_time_ms: float
    threads_used: int
    chunk_kb_used: int
    execution_mode_used: str


def _language(language: str | None, config: LanguageConfig | None) -> tuple[str, Rules]:
    if config is not None:
        return f"custom({config.metadata.code})", Rules(config)
    name = (language or "en").lower()
    if name not in _NAMES:
        raise InvalidLanguageError(f"unknown language {language!r}; there are {', '.join(supported_languages())}")
    return _NAMES[name], Rules(bundled(_NAMES[name]))


def _options(threads: int | None, chunk_kb: int | None, mode: str) -> None:
    if mode not in MODES:
        raise ConfigurationError(f"unknown execution mode {mode!r}; there are {', '.join(MODES)}")
    if threads is not None and threads < 1:
        raise ConfigurationError("threads must be 1 or more")
    if chunk_kb is not None and chunk_kb < 1:
        raise ConfigurationError("chunk_kb must be 1 or more")


def _planned(size: int, threads: int | None, chunk_kb: int | None, mode: str) -> tuple[str, int, int]:
    """(mode, threads, characters in a part) of a text of `size` characters: adaptive cuts texts of four parts or more."""
    part = (chunk_kb or 256) * 1024
    if mode == "adaptive":
        mode = "parallel" if size >= 4 * part and (threads or os.cpu_count() or 1) > 1 else "sequential"
    if mode == "sequential":
        return mode, 1, max(1, part if chunk_kb else size)
    return mode, threads or Config().parts(size), part


def _ends(rules: Rules, text: str, threads: int | None, chunk_kb: int | None, mode: str) -> list[int]:
    _, n, part = _planned(len(text), threads, chunk_kb, mode)
    return rules.scan_parts(text, part, n).boundaries()


def split(
    input: Any,
    *,
    language: str | None = None,
    language_config: LanguageConfig | None = None,
    threads: int | None = None,
    chunk_kb: int | None = None,
    parallel: bool = False,
    execution_mode: str = "adaptive",
    return_details: bool = False,
    preserve_whitespace: bool = False,
    encoding: str = "utf-8",
) -> list[str] | list[Sentence] | DataFrame | Column:
    """The sentences of one text. Mode, threads and chunk size say in what parts it is scanned and never change the result.

    A DataFrame with a column `text` is given back with an array column `sentences` of (text, start, end); a string column
    gives a column of arrays of sentences. There Spark's partitions are the parts, and the options are only checked.
    """
    _options(threads, chunk_kb, execution_mode)
    _, rules = _language(language, language_config)
    if isinstance(input, DataFrame):
        from clausemill.operators.segment import sentence_arrays

        return sentence_arrays(input, rules.config, preserve_whitespace=preserve_whitespace)
    if isinstance(input, Column):
        from clausemill.functions.sql import sentences_of

        return sentences_of(input, rules.config, preserve_whitespace)
    text = text_of(input, encoding)
    found = rules.slices(text, preserve_whitespace, _ends(rules, text, threads, chunk_kb, "parallel" if parallel and execution_mode == "adaptive" else execution_mode))
    return [Sentence(t, s, e) for s, e, t in found] if return_details else [t for _, _, t in found]


class SentenceIterator:
    """Sentences one by one."""

    def __init__(self, sentences: list[str]):
        self._rest = iter(sentences)

    def __iter__(self) -> SentenceIterator:
        return self

    def __next__(self) -> str:
        return next(self._rest)


def iter_split(input: Any, *, language: str | None = None, language_config: LanguageConfig | None = None, threads: int | None = None, chunk_kb: int | None = None, encoding: str = "utf-8") -> SentenceIterator:
    _, rules = _language(language, language_config)
    _options(threads, chunk_kb, "adaptive")
    return SentenceIterator([t for _, _, t in rules.slices(stream_text_of(input, encoding))])


class Feeder:
    """Sentences of a text that arrives in fragments, exactly as of the whole: sums are carried, contexts kept."""

    def __init__(self, rules: Rules, preserve_whitespace: bool = False):
        self.rules, self.keep = rules, preserve_whitespace
        self.before = ""  # context before what is not scanned yet
        self.todo = ""  # not scanned: what may still get context from the next fragment
        self.open = ""  # scanned since the last sentence end
        self.depths, self.parity = list(rules.zero), 0
        self.at_byte = 0  # where `open` begins
        self.starts: list[int] = []  # bytes where the sentences given out by the last feed() begin, white space included

    def feed(self, fragment: str, last: bool = False) -> list[str]:
        self.todo += fragment
        self.starts = []
        ready = len(self.todo) if last else max(0, len(self.todo) - REACH)
        out: list[str] = []
        if ready:
            text = self.before + self.todo
            at = len(self.before)
            state = self.rules.scan(text, at, at + ready)
            start = 0
            for place, depths, parity, _ in state.candidates:
                if not parity ^ self.parity and all(a + b <= 0 for a, b in zip(self.depths, depths, strict=True)):
                    out += self._cut(self.open + self.todo[start:place])
                    self.open, start = "", place
            self.open += self.todo[start:ready]
            self.depths = [a + b for a, b in zip(self.depths, state.depths, strict=True)]
            self.parity ^= state.parity
            self.before, self.todo = text[: at + ready][-REACH:], self.todo[ready:]
        if last:
            out += self._cut(self.open)
            self.open = ""
        return out

    def _cut(self, piece: str) -> list[str]:
        bare = trimmed(piece)
        start, self.at_byte = self.at_byte, self.at_byte + len(piece.encode())
        if not bare:
            return []
        self.starts.append(start)
        return [piece if self.keep else bare]


def split_large_file(file_path: str | Path, *, language: str | None = None, language_config: LanguageConfig | None = None, max_memory_mb: int = 100, overlap_size: int = 1024, encoding: str = "utf-8") -> Iterator[str]:
    """Sentences of a file that is read in parts of max_memory_mb / 4; overlap_size is taken and not needed."""
    path = Path(file_path)
    if not path.exists():
        raise FileNotFoundError(f"no such file: {path}")
    if max_memory_mb < 1 or overlap_size < 0:
        raise ConfigurationError("max_memory_mb must be 1 or more, overlap_size 0 or more")
    _, rules = _language(language, language_config)
    strict = encoding.strip().lower() in ENCODINGS
    codec = codecs.lookup(encoding).name

    def run() -> Iterator[str]:
        feeder = Feeder(rules)
        with open(path, encoding=codec, errors="strict" if strict else "replace", newline="") as f:
            while part := f.read(max(1, max_memory_mb * 1024 * 1024 // 4)):
                yield from feeder.feed(part)
        yield from feeder.feed("", last=True)

    return run()


class SentenceSplitter:
    """Compiled rules for many texts."""

    def __init__(self, *, language: str | None = None, language_config: LanguageConfig | None = None, threads: int | None = None, chunk_kb: int | None = None, execution_mode: str = "adaptive", streaming: bool = False, stream_chunk_mb: int = 10):
        _options(threads, chunk_kb, execution_mode)
        if stream_chunk_mb < 1:
            raise ConfigurationError("stream_chunk_mb must be 1 or more")
        self._language, self.rules = _language(language, language_config)
        self.threads, self.chunk_kb, self.execution_mode, self.streaming = threads, chunk_kb or (32 if streaming else 256), execution_mode, streaming

    def split(self, input: Any, *, return_details: bool = False, encoding: str = "utf-8") -> list[str] | list[Sentence]:
        """As the function; but a text without sentences gives itself, trimmed, as the only one."""
        if isinstance(input, DataFrame):
            from clausemill.operators.segment import sentence_arrays

            return sentence_arrays(input, self.rules.config, whole_if_none=True)
        text = text_of(input, encoding)
        found = self.rules.slices(text, False, _ends(self.rules, text, self.threads, self.chunk_kb, self.execution_mode)) or [(0, len(text), trimmed(text))]
        return [Sentence(t, s, e) for s, e, t in found] if return_details else [t for _, _, t in found]

    def iter_split(self, input: Any, *, encoding: str = "utf-8", preserve_whitespace: bool = False) -> SentenceIterator:
        return SentenceIterator([t for _, _, t in self.rules.slices(stream_text_of(input, encoding), preserve_whitespace)])

    def process(self, input: Any, encoding: str = "utf-8") -> tuple[list[tuple[int, int]], dict[str, Any]]:
        """(byte offset, character offset) of each sentence end, and figures of the run."""
        began = time.perf_counter()
        text = text_of(input, encoding)
        mode, threads, part = _planned(len(text), self.threads, self.chunk_kb, self.execution_mode)
        places = self.rules.scan_parts(text, part, threads).boundaries()
        from clausemill.operators.segment import byte_sizes

        n = len(places)
        stats = {"bytes_processed": len(text.encode()), "chars_processed": len(text), "sentence_count": n, "avg_sentence_length": len(text) / n if n else 0.0, "strategy_used": mode, "chunks_processed": max(1, -(-len(text) // part)), "threads_used": threads, "duration": time.perf_counter() - began}
        return list(zip(byte_sizes(text, places), places, strict=True)), stats

    @classmethod
    def with_config(cls, config: Config) -> SentenceSplitter:
        return cls(language=resolve_code(config.language), threads=config.threads, chunk_kb=max(1, config.chunk_size // 1024))

    @classmethod
    def with_language(cls, code: str) -> SentenceSplitter:
        """Any name of a bundled language."""
        return cls(language=resolve_code(code))

    def process_stream(self, reader: Any, encoding: str = "utf-8") -> tuple[list[tuple[int, int]], dict[str, Any]]:
        """`process` of all that a reader gives."""
        return self.process(reader, encoding)

    def config(self) -> Config:
        return Config(self._language if self._language in supported_languages() else "en", self.chunk_kb * 1024, self.threads)

    @property
    def language(self) -> str:
        return self._language

    @property
    def supports_parallel(self) -> bool:
        return True

    def __enter__(self) -> SentenceSplitter:
        return self

    def __exit__(self, *_: object) -> bool:
        return False

    def __repr__(self) -> str:
        return f"SentenceSplitter(language={self._language!r}, threads={self.threads}, chunk_kb={self.chunk_kb})"


Processor = SentenceSplitter


def load(language: str, *, threads: int | None = None, chunk_kb: int | None = None, execution_mode: str = "adaptive") -> SentenceSplitter:
    return SentenceSplitter(language=language, threads=threads, chunk_kb=chunk_kb, execution_mode=execution_mode)


@dataclass(frozen=True)
class Config:
    """Options of a processor; the presets differ in chunk size and threads only."""

    language: str = "en"
    chunk_size: int = 256 * 1024
    threads: int | None = None

    def __post_init__(self) -> None:
        if self.chunk_size < 1:
            raise ConfigurationError("chunk_size must be 1 or more")
        if self.threads is not None and self.threads < 1:
            raise ConfigurationError("threads must be 1 or more")
        bundled(self.language)

    @staticmethod
    def builder() -> ConfigBuilder:
        return ConfigBuilder()

    @classmethod
    def small_text(cls) -> Config:
        return cls(chunk_size=8 * 1024)

    @classmethod
    def large_text(cls) -> Config:
        return cls(chunk_size=512 * 1024)

    @classmethod
    def streaming(cls) -> Config:
        return cls(chunk_size=32 * 1024, threads=2)

    def parts(self, size: int) -> int:
        """How many parts an adaptive run cuts a text of `size` bytes into: a partitioning hint."""
        if self.threads:
            return self.threads
        return 1 if size < 256 * 1024 else min(size // (256 * 1024), os.cpu_count() or 1)


class ConfigBuilder:
    """Options one by one; errors, also of the language, come with build()."""

    def __init__(self) -> None:
        self._options: dict[str, Any] = {}

    def language(self, code: str) -> ConfigBuilder:
        self._options["language"] = code
        return self

    def chunk_size(self, size: int) -> ConfigBuilder:
        self._options["chunk_size"] = size
        return self

    def threads(self, n: int | None) -> ConfigBuilder:
        self._options["threads"] = n
        return self

    def build(self) -> Config:
        return Config(**self._options)


__all__ = ["Config", "ConfigBuilder", "Feeder", "ProcessingMetadata", "Processor", "Sentence", "SentenceIterator", "SentenceSplitter", "iter_split", "load", "split", "split_large_file", "supported_languages"]

"""Command line: process, validate, generate-config, list."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from clausemill.api import Feeder
from clausemill.config import LanguageConfig, supported_languages
from clausemill.errors import InvalidInputError, SegmentationError
from clausemill.kernel import Rules
from clausemill.operators.segment import byte_sizes
from clausemill.sources.readers import decoded, resolve
from clausemill.sources.sinks import FORMATS, Formatter

TEMPLATE = '''# Rules for {code}: edit what differs from these defaults.

[metadata]
code = "{code}"
name = "{name}"

[terminators]
chars = [".", "!", "?"]
# Marks of more than one character that end a sentence as a whole.
patterns = [{{ pattern = "!?", name = "surprised_question" }}]

[ellipsis]
treat_as_boundary = true
patterns = ["...", "…"]
context_rules = [{{ condition = "followed_by_capital", boundary = true }}, {{ condition = "followed_by_lowercase", boundary = false }}]
exceptions = []

[enclosures]
pairs = [{{ open = "(", close = ")" }}, {{ open = '"', close = '"', symmetric = true }}]

[suppression]
fast_patterns = [{{ char = "'", before = "alpha", after = "alpha" }}, {{ char = ")", line_start = true, before = "alnum" }}]

[abbreviations]
common = ["etc", "vs"]

[sentence_starters]
common = ["The", "It"]
'''


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="clausemill", description="Sentence segmentation")
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("process", help="split files or standard input")
    p.add_argument("-i", "--input", action="append", required=True, help="files or patterns; - is standard input")
    p.add_argument("-o", "--output")
    p.add_argument("-f", "--format", choices=FORMATS, default="text")
    which = p.add_mutually_exclusive_group()
    which.add_argument("-l", "--language", default=None)
    which.add_argument("-c", "--language-config")
    p.add_argument("--language-code")
    p.add_argument("-p", "--parallel", action="store_true")
    p.add_argument("--adaptive", action="store_true")
    p.add_argument("-t", "--threads", type=int)
    p.add_argument("--chunk-kb", type=int)
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("--stream", action="store_true")
    p.add_argument("--stream-chunk-mb", type=int, default=10)
    p.add_argument("--spark", action="store_true", help="read the files as one Spark job; the output is the same")
    v = commands.add_parser("validate", help="check a file of rules")
    v.add_argument("-c", "--language-config", required=True)
    v.add_argument("--language-code")
    g = commands.add_parser("generate-config", help="write a template of rules")
    g.add_argument("-l", "--language-code", required=True)
    g.add_argument("-n", "--name")
    g.add_argument("-o", "--output", required=True)
    commands.add_parser("list", help="what there is").add_argument("what", choices=("languages", "formats"))
    return top


def _rules(path: str | None, code: str | None, language: str | None) -> Rules:
    if not path:
        return Rules.of(language or "en")
    return Rules(LanguageConfig.from_toml(path, code))


def _process(a: argparse.Namespace) -> None:
    if (a.threads is not None and a.threads < 1) or (a.chunk_kb is not None and a.chunk_kb < 1):
        raise SegmentationError("threads and chunk-kb must be 1 or more")
    rules, out = _rules(a.language_config, a.language_code, a.language), Formatter(a.format)
    target = open(a.output, "w", encoding="utf-8", newline="") if a.output else sys.stdout
    try:
        for found in _found(a, rules):
            target.write(out.add(found))
        target.write(out.finish())
    finally:
        if a.output:
            target.close()
    if not a.quiet and a.output:
        print(f"{out.n} sentences", file=sys.stderr)


def _found(a: argparse.Namespace, rules: Rules):
    if a.input == ["-"]:
        yield _pairs(rules, sys.stdin.read())
        return
    paths = resolve(a.input)
    if not a.spark:
        progress = Progress(len(paths), not a.quiet and sys.stderr.isatty())
        for path in paths:
            if a.verbose:
                print(path, file=sys.stderr)
            if a.stream or should_stream(path, a.stream_chunk_mb):
                yield from _streamed(rules, path, a.stream_chunk_mb)
            else:
                yield _pairs(rules, decoded(Path(path).read_bytes()))
            progress.step(path)
        progress.finish()
        return
    from pyspark.sql import SparkSession

    from clausemill.operators.segment import sentences
    from clausemill.sources.readers import files

    spark = SparkSession.builder.getOrCreate()
    rows = sentences(files(spark, [Path(p).resolve().as_uri() for p in paths]), ["path"], rules.config)
    yield ((r["text"], r["start_byte"]) for r in rows.orderBy("path", "idx").toLocalIterator())


def _pairs(rules: Rules, text: str) -> list[tuple[str, int]]:
    found = rules.slices(text)
    return [(t, b) for (_, _, t), b in zip(found, byte_sizes(text, [s for s, _, _ in found]), strict=True)]


def should_stream(path: str, chunk_mb: int) -> bool:
    """Files of more than ten parts are read in parts."""
    return os.path.getsize(path) > 10 * chunk_mb * 1024 * 1024


def _streamed(rules: Rules, path: str, chunk_mb: int):
    """As `_pairs`, of a file that is read in parts; sums are carried, so the result is the same."""
    feeder = Feeder(rules)
    try:
        with open(path, encoding="utf-8", newline="") as f:
            while part := f.read(max(1, chunk_mb) * 1024 * 1024):
                yield list(zip(feeder.feed(part), feeder.starts, strict=True))
        yield list(zip(feeder.feed("", last=True), feeder.starts, strict=True))
    except UnicodeDecodeError as e:
        raise InvalidInputError(f"cannot decode as utf-8: {e}") from e


class Progress:
    """A bar of finished files on standard error, if `shown`."""

    def __init__(self, total: int, shown: bool):
        self.total, self.shown, self.done = total, shown, 0

    def step(self, name: str) -> None:
        self.done += 1
        if self.shown:
            full = 30 * self.done // max(1, self.total)
            print(f"\r[{'=' * full}{' ' * (30 - full)}] {self.done}/{self.total} {Path(name).name[:40]:<40}", end="", file=sys.stderr, flush=True)

    def finish(self) -> None:
        if self.shown and self.done:
            print(file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    try:
        if a.command == "process":
            _process(a)
        elif a.command == "validate":
            config = _rules(a.language_config, a.language_code, None).config
            print(f"✓ {config.metadata.name} ({config.metadata.code}): the rules are valid")
        elif a.command == "generate-config":
            Path(a.output).write_text(TEMPLATE.format(code=a.language_code, name=a.name or a.language_code), encoding="utf-8")
            print(f"✓ wrote {a.output}")
        else:
            print("\n".join(supported_languages() if a.what == "languages" else FORMATS))
    except (SegmentationError, OSError) as e:
        print(f"✗ {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

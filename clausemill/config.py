"""Language rules: the schema, its TOML form, validation, and the bundled languages."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field
from enum import Enum
from functools import cache
from importlib import resources
from pathlib import Path
from typing import Any

import regex

from clausemill.errors import ConfigurationError, InvalidLanguageError

#: Characters of context on each side that a rule may read.
REACH = 32


@dataclass
class MetadataConfig:
    code: str
    name: str


@dataclass
class TerminatorPattern:
    pattern: str
    name: str = ""


@dataclass
class TerminatorConfig:
    chars: list[str]
    patterns: list[TerminatorPattern] = field(default_factory=list)


@dataclass
class ContextRule:
    condition: str
    boundary: bool


@dataclass
class ExceptionPattern:
    regex: str
    boundary: bool


@dataclass
class EllipsisConfig:
    treat_as_boundary: bool = True
    patterns: list[str] = field(default_factory=lambda: ["...", "…"])
    context_rules: list[ContextRule] = field(default_factory=list)
    exceptions: list[ExceptionPattern] = field(default_factory=list)


@dataclass
class EnclosurePair:
    open: str
    close: str
    symmetric: bool = False


@dataclass
class EnclosureConfig:
    pairs: list[EnclosurePair] = field(default_factory=list)


@dataclass
class FastPattern:
    char: str
    line_start: bool = False
    before: str | None = None
    after: str | None = None


@dataclass
class RegexPattern:
    pattern: str
    description: str | None = None


@dataclass
class SuppressionConfig:
    fast_patterns: list[FastPattern] = field(default_factory=list)
    regex_patterns: list[RegexPattern] = field(default_factory=list)


class _Categories:
    """Lists of words by category."""

    categories: dict[str, list[str]]

    def __getitem__(self, key: str) -> list[str]:
        return self.categories[key]

    def __setitem__(self, key: str, value: list[str]) -> None:
        self.categories[key] = list(value)

    def __eq__(self, other: object) -> bool:
        return type(other) is type(self) and vars(other) == vars(self)

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in vars(self).items())})"

    def words(self) -> list[str]:
        return [w for words in self.categories.values() for w in words]


class AbbreviationConfig(_Categories):
    def __init__(self, **categories: list[str]):
        self.categories = {k: list(v) for k, v in categories.items()}


class SentenceStarterConfig(_Categories):
    def __init__(self, require_following_space: bool = True, min_word_length: int = 1, **categories: list[str]):
        self.require_following_space, self.min_word_length = require_following_space, min_word_length
        self.categories = {k: list(v) for k, v in categories.items()}


@dataclass
class LanguageConfig:
    metadata: MetadataConfig
    terminators: TerminatorConfig
    ellipsis: EllipsisConfig = field(default_factory=EllipsisConfig)
    enclosures: EnclosureConfig = field(default_factory=EnclosureConfig)
    suppression: SuppressionConfig = field(default_factory=SuppressionConfig)
    abbreviations: AbbreviationConfig = field(default_factory=AbbreviationConfig)
    sentence_starters: SentenceStarterConfig | None = None

    @classmethod
    def from_toml(cls, path: str | Path, code: str | None = None) -> LanguageConfig:
        """Rules from a file, valid; `code` stands in for the code that the file gives."""
        try:
            text = Path(path).read_text(encoding="utf-8")
        except OSError as e:
            raise ConfigurationError(f"cannot read {path}: {e}") from e
        config = cls.from_text(text)
        if code:
            config.metadata.code = code
        return config

    @classmethod
    def from_text(cls, text: str) -> LanguageConfig:
        try:
            config = _from_dict(tomllib.loads(text))
        except (tomllib.TOMLDecodeError, TypeError, KeyError, AttributeError, ValueError) as e:
            raise ConfigurationError(f"bad language rules: {e}") from e
        config.validate()
        return config

    def to_toml(self, path: str | Path) -> None:
        self.validate()
        Path(path).write_text(self.to_text(), encoding="utf-8")

    def to_text(self) -> str:
        def table(name: str, items: dict[str, Any]) -> str:
            return f"[{name}]\n" + "".join(f"{_key(k)} = {_value(v)}\n" for k, v in items.items() if v is not None)

        starters = self.sentence_starters
        parts = [
            table("metadata", vars(self.metadata)),
            table("terminators", {"chars": [c[:1] for c in self.terminators.chars if c], "patterns": self.terminators.patterns}),
            table("ellipsis", vars(self.ellipsis)),
            table("enclosures", vars(self.enclosures)),
            table("suppression", vars(self.suppression)),
            table("abbreviations", self.abbreviations.categories),
        ]
        if starters is not None:
            parts.append(table("sentence_starters", {"require_following_space": starters.require_following_space, "min_word_length": starters.min_word_length} | starters.categories))
        return "\n".join(parts)

    def validate(self) -> None:
        """Raise ConfigurationError unless the rules can be compiled."""

        def need(ok: object, said: str) -> None:
            if not ok:
                raise ConfigurationError(said)

        need(self.metadata.code, "a language code is required")
        need(self.metadata.name, "a language name is required")
        need(self.terminators.chars, "at least one terminator character is required")
        for p in self.suppression.regex_patterns:
            checked(p.pattern)
        for e in self.ellipsis.exceptions:
            checked(e.regex)
        for category, words in self.abbreviations.categories.items():
            need(words, f"abbreviation category {category!r} is empty")
        if self.sentence_starters is not None:
            need(self.sentence_starters.categories, "sentence_starters needs at least one category")
            for category, words in self.sentence_starters.categories.items():
                need(words, f"sentence starter category {category!r} is empty")


#: What a linear-time engine has not: looking around and back references.
_UNSUPPORTED = regex.compile(r"(?<!\\)(?:\\\\)*(?:\(\?(?:[=!]|<[=!]|>)|\\[1-9])")


def checked(pattern: str) -> regex.Pattern:
    """The compiled pattern; ConfigurationError for one that is bad or looks around."""
    if _UNSUPPORTED.search(pattern):
        raise ConfigurationError(f"pattern {pattern!r} uses looking around or back references")
    try:
        return regex.compile(pattern, regex.V1)
    except regex.error as e:
        raise ConfigurationError(f"bad pattern {pattern!r}: {e}") from e


def _from_dict(raw: dict[str, Any]) -> LanguageConfig:
    starters = raw.get("sentence_starters")
    suppression, terminators, ellipsis = raw["suppression"], raw["terminators"], raw["ellipsis"]
    for c in [*terminators["chars"], *(p[k] for p in raw["enclosures"]["pairs"] for k in ("open", "close")), *(p["char"] for p in suppression.get("fast_patterns", []))]:
        if len(c) != 1:
            raise ValueError(f"{c!r} is not one character")
    return LanguageConfig(
        MetadataConfig(**{k: raw["metadata"][k] for k in ("code", "name")}),
        TerminatorConfig(list(terminators["chars"]), [TerminatorPattern(p["pattern"], p["name"]) for p in terminators.get("patterns", [])]),
        EllipsisConfig(ellipsis.get("treat_as_boundary", True), list(ellipsis["patterns"]), [ContextRule(r["condition"], r["boundary"]) for r in ellipsis.get("context_rules", [])], [ExceptionPattern(r["regex"], r["boundary"]) for r in ellipsis.get("exceptions", [])]),
        EnclosureConfig([EnclosurePair(p["open"], p["close"], p.get("symmetric", False)) for p in raw["enclosures"]["pairs"]]),
        SuppressionConfig([FastPattern(p["char"], p.get("line_start", False), p.get("before"), p.get("after")) for p in suppression.get("fast_patterns", [])], [RegexPattern(p["pattern"], p.get("description")) for p in suppression.get("regex_patterns", [])]),
        AbbreviationConfig(**raw["abbreviations"]),
        None if starters is None else SentenceStarterConfig(**starters),
    )


def _key(name: str) -> str:
    return name if regex.fullmatch(r"[A-Za-z0-9_-]+", name) else json.dumps(name)


def _value(v: Any) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False).replace("\x7f", "\\u007f")
    if isinstance(v, list):
        return f"[{', '.join(map(_value, v))}]"
    if isinstance(v, int):
        return str(v)
    return "{ " + ", ".join(f"{k} = {_value(x)}" for k, x in vars(v).items() if x is not None) + " }"


#: Names that each bundled language answers to.
CODES = {"en": ("en", "eng", "english"), "ja": ("ja", "jpn", "japanese")}


def supported_languages() -> list[str]:
    return list(CODES)


def resolve_code(code: str) -> str:
    """The bundled code that a name stands for, in any case and with white space around it."""
    name = code.strip().lower()
    for known, names in CODES.items():
        if name in names:
            return known
    raise InvalidLanguageError(f"unknown language {code!r}; there are {', '.join(CODES)}")


class Language(Enum):
    ENGLISH = "en"
    JAPANESE = "ja"

    @classmethod
    def parse(cls, name: str) -> Language:
        """By any of its names; InvalidLanguageError for an unknown one."""
        return cls(resolve_code(name))

    @classmethod
    def from_code(cls, name: str) -> Language:
        """By any of its names; English for an unknown one."""
        try:
            return cls.parse(name)
        except InvalidLanguageError:
            return cls.ENGLISH


@cache
def bundled(code: str) -> LanguageConfig:
    known = resolve_code(code)
    return LanguageConfig.from_text(resources.files("clausemill.languages").joinpath(f"{known}.toml").read_text(encoding="utf-8"))

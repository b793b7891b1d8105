"""Texts from files, bytes, readers and literals; as DataFrames, or as one text on the driver."""

from __future__ import annotations

import codecs
import glob
import io
import os
import sys
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.errors import InvalidInputError

#: Encodings of whole inputs, by the names they answer to.
ENCODINGS = {"utf-8": "UTF-8", "utf8": "UTF-8", "ascii": "US-ASCII", "us-ascii": "US-ASCII", "latin-1": "ISO-8859-1", "latin1": "ISO-8859-1", "iso-8859-1": "ISO-8859-1"}


def files(spark: SparkSession, paths: str | list[str], encoding: str = "utf-8") -> DataFrame:
    """path, text: whole files. Bytes that the encoding does not have raise; a byte-order mark stays."""
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select("path", from_bytes(F.col("content"), encoding, F.col("path")).alias("text"))


def from_bytes(content: Column, encoding: str = "utf-8", name: Column | None = None) -> Column:
    """The text of a binary column; null stays null. Bytes that the encoding does not have raise and name the row."""
    charset = ENCODINGS.get(encoding.strip().lower())
    if charset is None:
        raise LookupError(f"unknown encoding: {encoding}")
    if charset == "UTF-8":
        good, text = F.is_valid_utf8(content.cast("string")), content.cast("string")
    elif charset == "US-ASCII":
        good, text = ~F.hex(content).rlike("^(..)*?[89A-F]."), F.decode(content, charset)
    else:
        good, text = F.lit(True), F.decode(content, charset)
    bad = F.raise_error(F.concat(F.lit(f"not {charset}: "), F.lit("a value") if name is None else name.cast("string")))
    return F.when(content.isNull() | good, text).otherwise(bad.cast("string"))


def resolve(patterns: list[str]) -> list[str]:
    """Files that the patterns match, sorted, each once; FileNotFoundError if there are none."""
    found = sorted({p for pattern in patterns for p in glob.glob(pattern, recursive=True) if os.path.isfile(p)})
    if not found:
        raise FileNotFoundError(f"no files match {', '.join(patterns)}")
    return found


def lines_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, value), a row for each line of the files that appear in a folder."""
    return spark.readStream.format("text").load(folder).select(F.input_file_name().alias("path"), "value")


def literal(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")


def decoded(raw: bytes, encoding: str = "utf-8") -> str:
    name = ENCODINGS.get(encoding.strip().lower())
    if name is None:
        raise LookupError(f"unknown encoding: {encoding}")
    try:
        return raw.decode(name)
    except UnicodeDecodeError as e:
        raise InvalidInputError(f"cannot decode as {encoding}: {e}") from e


def text_of(source: Any, encoding: str = "utf-8") -> str:
    """One text from bytes, a path object, a reader, or a string (the path of a file that is there, else the text)."""
    if isinstance(source, (bytes, bytearray)):
        return decoded(bytes(source), encoding)
    if not isinstance(source, str) and hasattr(source, "__fspath__"):
        return _file(Path(source), encoding)
    if hasattr(source, "read"):
        value = source.read()
        if isinstance(value, str):
            return value
        if isinstance(value, (bytes, bytearray)):
            return decoded(bytes(value), encoding)
        raise TypeError(f"read() gave {type(value).__name__}, not str or bytes")
    if isinstance(source, str):
        try:
            there = len(source) < 4096 and "\0" not in source and os.path.isfile(source)
        except (OSError, ValueError):
            there = False
        return _file(Path(source), encoding) if there else source
    raise TypeError(f"expected str, bytes, a path or a reader, not {type(source).__name__}")


def stream_text_of(source: Any, encoding: str = "utf-8") -> str:
    """As text_of, for iterators: paths and bytes are UTF-8; readers are read from their start and decoded with replacement."""
    if hasattr(source, "read") and not hasattr(source, "__fspath__"):
        if hasattr(source, "seek"):
            try:
                source.seek(0)
            except (OSError, io.UnsupportedOperation):
                pass
        value = source.read()
        if isinstance(value, str):
            return value
        if isinstance(value, (bytes, bytearray)):
            return bytes(value).decode(codecs.lookup(encoding).name, "replace")
        raise TypeError(f"read() gave {type(value).__name__}, not str or bytes")
    return text_of(source, "utf-8")


def _file(path: Path, encoding: str) -> str:
    if not path.exists():
        raise FileNotFoundError(f"no such file: {path}")
    return decoded(path.read_bytes(), encoding)


def stdin_text() -> str:
    return sys.stdin.read()

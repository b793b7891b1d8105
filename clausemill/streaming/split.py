"""Sentences of text streams, exact whatever the fragments: depths, parities and context are kept as state by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clausemill.api import Feeder
from clausemill.config import LanguageConfig
from clausemill.kernel import Rules
from clausemill.ship import ship

OUT = "stream_key string, idx long, text string"
STATE = "before string, todo string, open string, depths array<long>, parity long, n long"


def split_stream(fragments: DataFrame, language: str | LanguageConfig = "en", idle_ms: int | None = None, preserve_whitespace: bool = False) -> DataFrame:
    """(stream_key, seq, fragment, is_last) -> (stream_key, idx, text), append mode.

    In each trigger the fragments of a key are taken by seq. A sentence comes out as soon as 32 characters follow its
    end; the rest with the fragment that has is_last, or after idle_ms without news if that is given.
    """
    rules = Rules.of(language)
    ship(fragments.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        feeder, n = Feeder(rules, preserve_whitespace), 0
        if state.exists:
            feeder.before, feeder.todo, feeder.open, depths, parity, n = state.get
            feeder.depths, feeder.parity = [int(d) for d in depths], int(parity)
        if state.hasTimedOut:
            out, last = feeder.feed("", last=True), True
        else:
            rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
            out, last = [], False
            for fragment, ends in zip(rows["fragment"], rows["is_last"], strict=True):
                last = bool(ends)
                out += feeder.feed(fragment or "", last=last)
        if last:
            state.remove()
        else:
            state.update((feeder.before, feeder.todo, feeder.open, feeder.depths, feeder.parity, n + len(out)))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame({"stream_key": [key[0]] * len(out), "idx": range(n, n + len(out)), "text": out})

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return fragments.groupBy("stream_key").applyInPandasWithState(step, OUT, STATE, "append", timeout)


def split_batches(fragments: DataFrame, language: str | LanguageConfig = "en", preserve_whitespace: bool = False) -> DataFrame:
    """The same over a table of fragments: each key is put through one feeder, in order of seq."""
    rules = Rules.of(language)
    ship(fragments.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        feeder = Feeder(rules, preserve_whitespace)
        out = [s for f in rows.sort_values("seq")["fragment"] for s in feeder.feed(f or "")] + feeder.feed("", last=True)
        return pd.DataFrame({"stream_key": [rows["stream_key"].iloc[0]] * len(out), "idx": range(len(out)), "text": out})

    return fragments.groupBy("stream_key").applyInPandas(run, OUT)

"""The model behind a table: a user callable applied to batches of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def read_fields(df: DataFrame, predict: Callable[[pd.Series], pd.Series], content: str = "content") -> DataFrame:
    """``doc_id, raw, error`` from ``doc_id`` and a content column.

    ``predict`` maps a series of contents to a series of raw answers; an answer that is an
    exception is its row's error. When a call fails as a whole, its batch is halved until the
    documents that fail are alone, so one bad document costs a few calls and its own row.
    """

    def answers(items: pd.Series) -> list[tuple[str | None, str | None]]:
        try:
            found = list(predict(items))
            if len(found) != len(items):
                raise ValueError("predict must give one answer for each document")
        except Exception as exc:
            if len(items) == 1:
                return [(None, f"{type(exc).__name__}: {exc}")]
            half = len(items) // 2
            return answers(items.iloc[:half]) + answers(items.iloc[half:])
        return [(None, f"{type(x).__name__}: {x}") if isinstance(x, Exception) else (str(x), None) for x in found]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            pairs = answers(rows[content]) if len(rows) else []
            yield pd.DataFrame({"doc_id": rows["doc_id"].to_list(), "raw": [p[0] for p in pairs], "error": [p[1] for p in pairs]})

    return df.select("doc_id", content).mapInPandas(run, "doc_id long, raw string, error string")

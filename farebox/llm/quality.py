"""Quality: a numpy classifier from trusted good texts plus unlabelled web text (see `pu`)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from farebox.llm import pu

SETTINGS = pu.Settings(label="quality", without_positives=1.0)
THRESHOLD = 0.3


def score(docs: DataFrame, labels: DataFrame, settings: pu.Settings = SETTINGS) -> DataFrame:
    """`doc_id, held_out, score, predicted`: how likely each whole text is good. Without a good label, 1 for all."""
    return pu.score(docs, pu.train(docs, labels, settings), THRESHOLD)


def keep_good(docs: DataFrame, labels: DataFrame, settings: pu.Settings = SETTINGS) -> DataFrame:
    """The rows of `docs` that are not rejected."""
    return pu.keep(docs, pu.train(docs, labels, settings), lambda s: s >= THRESHOLD)

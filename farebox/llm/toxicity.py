"""Toxicity: a numpy classifier from confirmed toxic examples plus unlabelled text (see `pu`)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from farebox.llm import pu

SETTINGS = pu.Settings(label="toxic", form=False, without_positives=0.0)
THRESHOLD = 0.5


def score(docs: DataFrame, labels: DataFrame, settings: pu.Settings = SETTINGS) -> DataFrame:
    """`doc_id, held_out, score, predicted`: how likely each whole text is toxic. Without a toxic label, 0 for all."""
    return pu.score(docs, pu.train(docs, labels, settings), THRESHOLD)


def keep_clean(docs: DataFrame, labels: DataFrame, settings: pu.Settings = SETTINGS) -> DataFrame:
    """The rows of `docs` that are not found toxic."""
    return pu.keep(docs, pu.train(docs, labels, settings), lambda s: s < THRESHOLD)

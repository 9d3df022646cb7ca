from __future__ import annotations

import public_tokenizers
import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def model_path() -> str:
    return str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns named as results and helpers are."""
    rows = [
        (1, "Plain text of a few words."), (2, None), (3, ""), (4, " \n\t "), (5, "word " * 30_000), (6, "x" * 50_000),
        (7, "same"), (7, "same"), (None, "no id"), (None, None), (8, "é ü ß 中文 😀"), (9, "\x00 odd \x85 bytes"),
    ]
    frame = spark.createDataFrame([(*r, None, "s", 0) for r in rows], DOCUMENTS)
    for name in ("score", "fp", "n_words", "component_id", "n_tokens", "positive", "word"):
        frame = frame.selectExpr("*", f"'clash' AS {name}")
    return frame.cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)

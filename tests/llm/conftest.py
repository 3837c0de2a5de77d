from __future__ import annotations

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, content string, digest string, gone long, row long, c0 string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, ties, and columns named like internal ones."""
    long = "the quick brown fox jumps over the lazy dog and runs away " * 3000
    rows = [
        (1, "A small text about the sea and the wind.", "en", "src1"),
        (2, None, "en", "src1"),
        (3, "", None, None),
        (4, "   \n\t ", "fr", "src2"),
        (5, long, "en", "src3"),
        (6, "A small text about the sea and the wind.", "en", "src1"),
        (6, "A small text about the sea and the wind.", "en", "src1"),
        (None, "A text without an id, about nothing much at all.", "en", None),
        (None, None, None, None),
        (7, "12345 67890 !!!", "de", "src4"),
        (-8, "Le vent et la mer, et le petit bateau qui rentre au port.", "fr", "src2"),
        (20, "<|endoftext|> is ordinary here; café ÜBER naïve \U0001f600 İstanbul", "en", "src9"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", 3, 4, "z") for r in rows], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def texts(spark, tables):
    """``{doc_id: text}`` of the smallest documents table."""
    return {r[0]: r[1] for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture
def scratch(tmp_path):
    return f"file://{tmp_path}"

"""Preprocessing: fixed-length chunking, quality statistics, quality mask.

Everything here is a narrow, per-row transformation (no shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as ST
from ..functions.text import chunk_words, is_blank


def chunk_documents(df: DataFrame, chunk_length: int = 128, id_col: str = "doc_id", text_col: str = "text",
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """Split every text on single spaces into pieces of ``chunk_length`` words.

    Key of a piece: ``(doc_id, chunk_no)`` (T15); the other ``keep`` columns
    (metadata) are repeated on every piece.
    """
    return df.select(F.col(id_col).alias("doc_id"), *keep,
                     F.posexplode(chunk_words(F.col(text_col), chunk_length)).alias("chunk_no", "contents"))


def compute_once(df: DataFrame, expr, name: str) -> DataFrame:
    """Add ``expr`` as column ``name``, evaluated exactly once per row.

    A one-element generator is a boundary the optimizer does not push filters
    or projections through, so later references (several statistics, a
    filter on them) do not re-evaluate an expensive expression.
    """
    return df.select("*", F.explode(F.array(expr)).alias(name))


def quality_stats(df: DataFrame, text_col: str = "text", uninformative: list[str] | None = None) -> DataFrame:
    """Add ``length, repeating_ratio, informative_ratio, numeric_ratio``.

    Tokens are computed once per row and all four statistics in one pass
    over them; each sits behind a generator boundary so a quality filter on
    the statistics never re-runs the tokenizer.
    """
    tok = compute_once(df, ST.treebank_tokens(F.col(text_col)), "_tok")
    t = F.col("_tok")
    stats = F.struct(F.size(t).cast("long").alias("length"),
                     ST.repeating_ratio(t).alias("repeating_ratio"),
                     ST.informative_ratio(t, uninformative).alias("informative_ratio"),
                     ST.numeric_ratio(t).alias("numeric_ratio"))
    out = tok.select(*[F.col(c) for c in df.columns], F.inline(F.array(stats)))
    return out


def repeating_top_n(df: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sum of the n largest token counts / number of tokens (T10), per row (no shuffle)."""
    tok = compute_once(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")),
                       ST.treebank_tokens(F.col("_text")), "_tok")
    return tok.select("doc_id", ST.repeating_top_n_ratio(F.col("_tok"), n).alias("repeating_top_n"))


def apply_quality_mask(df: DataFrame, bounds: dict | None = None) -> DataFrame:
    """Keep rows whose statistics pass the strict bounds."""
    return df.where(ST.quality_mask(bounds=bounds))


def drop_blank(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Drop null, empty and whitespace-only texts."""
    return df.where(~is_blank(F.col(text_col)))

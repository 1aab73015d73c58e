"""Text column functions: tokenizers, n-grams, chunking, text assembly.

All of these are JVM expressions (regex, higher-order array functions), so
they stay inside whole-stage code generation.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Word/punctuation token pattern: runs of letters, digits and
# underscore, or runs of anything that is neither such a character nor
# whitespace (Python's \w / \s spelt out so JVM, DuckDB and Python agree).
WORDPUNCT_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{Z}\s\x0B\x1C-\x1F\x85]+"

# Unicode whitespace as Python's str.isspace() sees it (for blank-line tests).
WHITESPACE_CLASS = r"[\s\p{Z}\x0B\x1C-\x1F\x85]"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def wordpunct_tokens(text: Column | str, lower: bool = True) -> Column:
    """Lower-case, then runs of word chars or runs of other non-space chars."""
    t = F.lower(_c(text)) if lower else _c(text)
    return F.regexp_extract_all(t, F.lit(WORDPUNCT_PATTERN), 0)


def treebank_tokens(text: Column | str, lower: bool = True) -> Column:
    """Treebank-style word tokens (quality statistics, classifier text); see ``stats``."""
    from .stats import treebank_tokens as _tb
    return _tb(text)


def whitespace_tokens(text: Column | str) -> Column:
    """``str.split()``: runs of non-whitespace (Unicode whitespace)."""
    return F.filter(F.split(_c(text), WHITESPACE_CLASS + "+"), lambda x: x != F.lit(""))


def space_split(text: Column | str) -> Column:
    """``str.split(' ')``: keeps empty pieces, like Python."""
    return F.split(_c(text), " ", -1)


TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "wordpunct": wordpunct_tokens,
    "word_tokenize": treebank_tokens,
    "whitespace": whitespace_tokens,
}


def get_tokenizer(name_or_fn: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Tokenizer by name, or a caller-supplied Column -> ARRAY<STRING> function."""
    if callable(name_or_fn):
        return name_or_fn
    try:
        return TOKENIZERS[name_or_fn]
    except KeyError:
        raise ValueError(f"tokenizer not recognized: {name_or_fn!r}") from None


def shifted_join(tokens: Column, i: int) -> Column:
    """All i-grams (i >= 2) of a token array, joined with one space."""
    n_out = F.greatest(F.size(tokens) - F.lit(i - 1), F.lit(0))
    out = F.slice(tokens, 1, n_out)
    for k in range(1, i):
        out = F.zip_with(out, F.slice(tokens, k + 1, n_out), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def ngrams(tokens: Column | str, n: int = 2) -> Column:
    """Unigrams followed by i-grams for i = 2..n (none when the text is too short)."""
    t = _c(tokens)
    out = t
    for i in range(2, n + 1):
        out = F.concat(out, shifted_join(t, i))
    return out


def example_length(n_tokens: Column | str, n: int) -> Column:
    """Per-example length from the n-gram count: floor((G + n(n-1)/2) / n)."""
    L = _c(n_tokens)
    g = None
    for i in range(1, n + 1):
        term = F.greatest(L - F.lit(i - 1), F.lit(0))
        g = term if g is None else g + term
    return F.floor((g + F.lit(n * (n - 1) // 2)) / F.lit(n)).cast("bigint")


def concat_text(*cols: str) -> Column:
    """Join several text columns with one space; null in any input gives null."""
    parts: list[Column] = []
    for c in cols:
        if parts:
            parts.append(F.lit(" "))
        parts.append(F.col(c))
    return F.concat(*parts)


def is_blank(text: Column | str) -> Column:
    """True for null, empty or whitespace-only text."""
    t = _c(text)
    return t.isNull() | (F.regexp_replace(t, WHITESPACE_CLASS, "") == F.lit(""))


def chunk_words(text: Column | str, chunk_length: int = 128) -> Column:
    """Split on single spaces into pieces of ``chunk_length`` words."""
    words = space_split(text)
    n_chunks = F.greatest(F.ceil(F.size(words) / F.lit(chunk_length)).cast("int"), F.lit(1))
    return F.transform(
        F.sequence(F.lit(0), n_chunks - F.lit(1)),
        lambda i: F.array_join(F.slice(words, i * F.lit(chunk_length) + F.lit(1), F.lit(chunk_length)), " "),
    )

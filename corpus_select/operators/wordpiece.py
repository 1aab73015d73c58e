"""Subword ids: basic word splitting and greedy longest-match WordPiece.

Tokenizers are not trained here. A vocabulary is any ``(token, id)`` table; continuation
pieces begin with ``##``. :func:`pieces_of_bpe` reads one from a public byte-pair file
whose tokens mark the ends of words.

Encoding is a narrow map: a task splits its texts with Arrow kernels, looks each distinct
word of a batch up once in a trie of the vocabulary and gathers the ids. No token is shuffled.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .mlm import N_SPECIAL, SMALL_VOCAB, UNK, fit_ids

CONTINUED = "##"
# Longer words become one unknown token, as usual for WordPiece.
MAX_WORD = 100
SLICE_BYTES = 8 << 20
KNOWN_WORDS = 200_000

# Which characters are dropped, stand alone or separate words. Single marks are
# all ASCII symbols and Unicode punctuation; ideographs are words of one character.
DROPPED = r"[^\P{C}\t\n\r]|\x{FFFD}"
ACCENT = r"\p{Mn}"
MARK = r"!-/:-@\[-`{-~\p{P}"
IDEOGRAPH = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
SPACE = r"[\t\n\r\p{Z}]+"


def pieces_of_bpe(path: str, end_of_word: str = "</w>") -> list[str]:
    """WordPiece tokens from a byte-pair vocabulary that marks word ends.

    Its printable ASCII tokens, without the mark, in the order of their ids: first as beginnings of
    words, then all again as continuations. The mark's difference is dropped, so every
    token may end a word.
    """
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    own: dict[str, None] = {}
    for token, _ in sorted(vocab.items(), key=lambda kv: kv[1]):
        core = token.removesuffix(end_of_word)
        if core and core.isascii() and core.isprintable() and " " not in core:
            own[core] = None
    return [*own, *(CONTINUED + p for p in own)]


def vocab_table(spark: SparkSession, pieces: list[str]) -> DataFrame:
    """``(token, id)`` with ids after the special tokens, in the order given."""
    return spark.createDataFrame(pa.table({"token": pa.array(pieces, pa.string()), "id": pa.array(np.arange(N_SPECIAL, N_SPECIAL + len(pieces)), pa.int32())}))


class Trie:
    """Nested dicts by character; a node's id is under the empty string."""

    def __init__(self, tokens: list[str], ids: list[int]):
        self.first: dict = {}
        self.rest: dict = {}
        for token, i in zip(tokens, ids):
            more = token.startswith(CONTINUED) and len(token) > len(CONTINUED)
            node = self.rest if more else self.first
            for c in token[len(CONTINUED):] if more else token:
                node = node.setdefault(c, {})
            node[""] = i

    def pieces(self, word: str, longest: int = MAX_WORD) -> list[int]:
        """Ids of the longest piece at each place; one [UNK] if a place has none or the word is too long."""
        if len(word) > longest:
            return [UNK]
        out, at, node = [], 0, self.first
        while at < len(word):
            found, end = None, at
            for k in range(at, len(word)):
                node = node.get(word[k])
                if node is None:
                    break
                if "" in node:
                    found, end = node[""], k + 1
            if found is None:
                return [UNK]
            out.append(found)
            at, node = end, self.rest
        return out


def basic_words(texts: pa.Array) -> pa.Array:
    """Lists of lower-cased words without accents; marks and ideographs are words of their own."""
    t = pc.replace_substring_regex(texts, DROPPED, "")
    t = pc.replace_substring_regex(pc.utf8_normalize(pc.utf8_lower(t), "NFD"), ACCENT, "")
    t = pc.replace_substring_regex(t, f"([{MARK}{IDEOGRAPH}])", r" \1 ")
    return pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(t, SPACE, " "), " "), " ")


def _gather(flat: np.ndarray, per: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The variable-length ``rows`` of ``flat``, one after the other."""
    starts, size = np.concatenate([[0], np.cumsum(per)]), per[rows]
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[rows] - (ends - size), size)]


def _encoder(shipped, columns: int):
    def fn(batches):
        tokens, ids = shipped.value
        trie, known = Trie(tokens, ids), {}

        def encode(texts: pa.Array) -> pa.Array:
            lists = basic_words(texts.cast(pa.large_string()).fill_null(""))
            words = pc.dictionary_encode(lists.flatten())
            if len(known) > KNOWN_WORDS:
                known.clear()
            found = []
            for w in words.dictionary.to_pylist():
                if w not in known:
                    known[w] = trie.pieces(w)
                found.append(known[w])
            per = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((i for f in found for i in f), np.int32, per.sum())
            rows = words.indices.to_numpy()
            # pieces before each word, read off at the texts' borders
            before = np.concatenate([[0], np.cumsum(per[rows])])
            ends = before[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)]
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_gather(flat, per, rows), pa.int32()))

        for b in batches:
            for part in _by_bytes(b):
                yield pa.RecordBatch.from_arrays([part.column(0), *(encode(c) for c in part.columns[1:])], names=["doc_id", *[f"ids{k}" for k in range(columns)]])
    return fn


def _by_bytes(b: pa.RecordBatch):
    """The batch in slices of about ``SLICE_BYTES`` of text (one row at least)."""
    size = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns[1:])
    ends, start = np.cumsum(size), 0
    while start < b.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_BYTES, side="right")))
        yield b.slice(start, stop - start)
        start = stop


def wordpiece_ids(df: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text_cols: tuple[str, ...] = ("text",)) -> DataFrame:
    """``doc_id`` and one array of ids per text column (``ids0``, ...), of the whole texts; null text has none.

    The vocabulary is shipped to the tasks; it may hold ``SMALL_VOCAB`` tokens.
    """
    known = vocab.select("token", "id").limit(SMALL_VOCAB + 1).toArrow()
    if known.num_rows > SMALL_VOCAB:
        raise ValueError(f"a vocabulary of more than {SMALL_VOCAB} tokens")
    spark = df.sparkSession
    ship_package(spark)
    shipped = spark.sparkContext.broadcast((known.column("token").to_pylist(), known.column("id").to_pylist()))
    rows = df.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"ids{k}") for k, c in enumerate(text_cols)])
    kinds = ", ".join(f"ids{k} array<int>" for k in range(len(text_cols)))
    return rows.mapInArrow(_encoder(shipped, len(text_cols)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {kinds}")


def wordpiece_encode(df: DataFrame, vocab: DataFrame, max_length: int = 128, id_col: str = "doc_id", text_col: str = "text", pair_col: str | None = None) -> DataFrame:
    """Subword ids truncated and padded to ``max_length``; columns as in :func:`mlm.encode`. Texts without a word are dropped."""
    ids = wordpiece_ids(df, vocab, id_col, (text_col, pair_col) if pair_col else (text_col,)).where(F.size("ids0") > 0)
    return fit_ids(ids, max_length, "ids0", "ids1" if pair_col else None)

"""Token counts at every prefix, for BPE files of the ``sentencepiece`` library with byte fallback.

A prefix's encoding ends with exactly one token that can follow the encoding of
the text before it. So one pass over a word fills, for each prefix, its last
token and ``count[i] = count[i - len(token)] + 1`` (dynamic programming over
prefixes). No piece holds a space after another character, so words do not
interact, and a text's counts are running sums over its words. Each distinct
word is worked once per worker while it stays in a bounded memo.

The stored counts answer truncation and budget questions without encoding again
(``fit_budget``).

Defined results: null text is empty and has no tokens; equal or null ids stay
separate rows; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, binary_array, codes_of, gathered, large, list_lengths, one_array, ragged_take, record_batch, starts_of, texts_of

SPACE = "▁"  # fixed value: how the pieces write a space


class PrefixCounts:
    """Prefix token counts of words under one model file."""

    def __init__(self, path: str, limit: int = 300_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.limit, self.memo = limit, {}
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        # ranks: single characters first, then merged pieces from the best score on
        plain.sort(key=lambda i: (len(sp.id_to_piece(i)) > 1, -sp.get_score(i), i))
        self.pieces = [sp.id_to_piece(i) for i in plain]
        self.rank = {p: r for r, p in enumerate(self.pieces)}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.pieces):
            raise ValueError(f"{path}: a piece spans words; words cannot be counted apart")
        self.longest = max(map(len, self.pieces))
        self.split: list[tuple[int, int]] = []
        self.joined: dict[tuple[int, int], int] = {}
        for r, p in enumerate(self.pieces):
            self.split.append((r, r))
            if len(p) > 1:
                halves = self._merged(p, r)
                if len(halves) == 2:
                    self.split[r] = (halves[0], halves[1])
                    self.joined[halves[0], halves[1]] = r
                else:  # never reached by merging
                    del self.rank[p]
        self.follows: dict[tuple[int, int], bool] = {}

    def _merged(self, text: str, below: int) -> list[int]:
        """Merge ``text``'s characters with pieces of rank under ``below``; best rank first, then leftmost."""
        own = [text[i] for i in range(len(text))]
        if any(c not in self.rank for c in own):
            return []
        while len(own) > 1:
            best, at = below, -1
            for i in range(len(own) - 1):
                r = self.rank.get(own[i] + own[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            own[at:at + 2] = [own[at] + own[at + 1]]
        return [self.rank[x] for x in own]

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between ``a`` and ``b`` uncrossed: undo both sides' merges, latest first."""
        key, bound = (a, b), len(self.pieces)
        known = self.follows.get(key)
        if known is not None:
            return known
        split, joined = self.split, self.joined
        # a merge across the border happens before `bound`; at equal rank the left one goes first
        while True:
            r = joined.get((a, b))
            if r is not None and r < bound:
                ok = False
                break
            left, right = split[a] != (a, a), split[b] != (b, b)
            if not left and not right:
                ok = True
                break
            if left and (not right or a > b):
                bound = a
                a = split[a][1]
            else:
                bound = b + 1
                b = split[b][0]
        if len(self.follows) > 2_000_000:
            self.follows.clear()
        self.follows[key] = ok
        return ok

    def word(self, w: str) -> list[int]:
        """Tokens of each prefix of ``w`` (spaces written as the pieces write them), from 1 character on."""
        rank, longest, may = self.rank, self.longest, self._may_follow
        last, count = [-1] * (len(w) + 1), [0] * (len(w) + 1)
        for i in range(1, len(w) + 1):
            for j in range(max(0, i - longest), i):
                r = rank.get(w[j:i])
                if r is not None and (j == 0 or last[j] < 0 or may(last[j], r)):
                    last[i], count[i] = r, count[j] + 1
                    break
            else:  # not in the vocabulary: one token per byte, and no merge crosses it
                last[i], count[i] = -1, count[i - 1] + len(w[i - 1].encode())
        return count[1:]

    def words(self, words: list[str]) -> list[np.ndarray]:
        """Steps of the counts (int8, one per character) of each word."""
        out, memo = [], self.memo
        for w in words:
            d = memo.get(w)
            if d is None:
                if len(memo) >= self.limit:
                    memo.clear()
                c = self.word(w)
                d = memo[w] = bytes((b - a) & 255 for a, b in zip([0, *c[:-1]], c))
            out.append(d)
        return out


_OWN: dict[str, PrefixCounts] = {}


def counter(path: str) -> PrefixCounts:
    if path not in _OWN:
        _OWN[path] = PrefixCounts(path)
    return _OWN[path]


_RUNS = re.compile(" +[^ \n]*|\n[^ \n]*")


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(units per text, code per unit, distinct units): a unit is a line break or a run of spaces with what follows it.

    The library writes a space before a text, so a text's first unit starts with one.
    Single spaces are split in Arrow; texts with runs of spaces take a pattern.
    """
    odd = pc.match_substring_regex(texts, "^ |  |" + SPACE).to_numpy(zero_copy_only=False)  # a written space counts as one
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    counts, flat = list_lengths(lists), lists.flatten()
    codes, distinct = codes_of(flat)
    words = [w if w[:1] == "\n" else SPACE + w for w in distinct.to_pylist()]
    counts[pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)] *= 0
    if odd.any() or (counts == 0).any():
        own = list_lengths(lists)
        starts, extra, parts, known = starts_of(own), {}, [], len(words)
        for i in range(len(texts)):
            if odd[i]:
                found = [u.replace(" ", SPACE) for u in _RUNS.findall(" " + texts[i].as_py().replace(SPACE, " "))]
                for u in found:
                    extra.setdefault(u, known + len(extra))
                parts.append(np.array([extra[u] for u in found], np.int64))
                counts[i] = len(found)
            elif counts[i]:
                parts.append(codes[starts[i]:starts[i + 1]])
        codes = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        words += list(extra)
    return counts, codes, words


def _counts(path: str, prefixes: bool):
    def run(batches):
        own = counter(path)
        for t in gathered(batches):
            texts = large(t.column("text"))
            counts, codes, words = units(texts)
            steps = own.words(words)
            width = np.fromiter(map(len, steps), np.int64, len(steps))
            flat = np.frombuffer(b"".join(steps), np.int8)
            total = np.zeros(len(steps), np.int64)
            if len(flat):
                sums = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])
                total = sums[starts_of(width)[1:]] - sums[starts_of(width)[:-1]]
            ends = starts_of(counts)
            at = np.concatenate([[0], np.cumsum(total[codes])])
            columns = {
                "doc_id": one_array(t.column("doc_id")),
                "n_chars": pc.utf8_length(texts).cast(pa.int64()),
                "n_bytes": pc.binary_length(texts).cast(pa.int64()),
                "n_tokens": pa.array(at[ends[1:]] - at[ends[:-1]], pa.int64()),
            }
            if prefixes:
                chars = np.concatenate([[0], np.cumsum(width[codes])])[ends]
                columns["steps"] = binary_array(ragged_take(flat, starts_of(width)[:-1], width, codes), chars).cast(pa.binary())
            yield record_batch(columns)
    return run


def prefix_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", prefixes: bool = True) -> DataFrame:
    """One row per text: doc_id, n_chars, n_bytes, n_tokens and, with ``prefixes``, steps.

    ``steps`` has one signed byte for the space the library writes before the text
    and one per character; the sum of the first 1 + p is the token count of the
    prefix of p characters (p = 0: no text, no tokens).
    """
    docs = texts_of(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs, _counts(path, prefixes), f"doc_id {kind}, n_chars long, n_bytes long, n_tokens long" + ", steps binary" * prefixes)


def _fit(budget: int):
    def run(batches):
        for b in batches:
            totals, chars, tokens = [], [], []
            for s in b.column("steps").to_pylist():
                own = np.frombuffer(s, np.int8)
                total = int(own.sum(dtype=np.int64))
                p, n = max(len(own) - 1, 0), total
                if total > budget:
                    c = np.cumsum(own, dtype=np.int64)
                    fits = np.flatnonzero(c[1:] <= budget)
                    p = int(fits[-1]) + 1 if len(fits) and budget >= 0 else 0
                    n = int(c[p]) if p else 0
                totals.append(total)
                chars.append(p)
                tokens.append(n)
            yield record_batch({"doc_id": b.column("doc_id"), "n_bytes": b.column("n_bytes"), "n_tokens": pa.array(totals, pa.int64()),
                                "fit_chars": pa.array(chars, pa.int64()), "fit_tokens": pa.array(tokens, pa.int64())})
    return run


def fit_budget(counts: DataFrame, budget: int) -> DataFrame:
    """What the stored counts alone answer: doc_id, n_bytes, n_tokens, and of the longest prefix with at most ``budget`` tokens fit_chars, fit_tokens."""
    kind = counts.schema["doc_id"].dataType.simpleString()
    return arrow_map(counts.select("doc_id", "n_bytes", "steps"), _fit(budget), f"doc_id {kind}, n_bytes long, n_tokens long, fit_chars long, fit_tokens long")


def over_limit(counts: DataFrame, limit: int = 4096) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)

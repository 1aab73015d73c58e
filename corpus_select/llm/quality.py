"""Quality classifier: a generalised additive model with pairwise interactions.

Features are numbers read off the whole text in Arrow maps. Cyclic boosting
visits one feature at a time and fits a shallow tree to the residuals; the trees
of a feature add up to one lookup table over its bins, and pairs of features
with the strongest leftover signal get two-dimensional tables. A score is the
sigmoid of a sum of table entries.

The model is fitted on the driver from a bounded sample of labelled rows
(``SAMPLE``, the rows with the smallest hashes); features and scores are made for
every row. The model's size depends on the bins and pairs alone.

Defined results: null text is empty; empty texts are scored like any other;
labels that are null, or whose id has no document, are left out, and an id with several labels takes the mean,
rounded up at one half; with one label class or no labels every score is that
class's share (one half if there are none); ids may repeat or be null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, codes_of, gathered, large, list_lengths, one_array, record_batch, slices, starts_of, texts_of

SAMPLE = 20_000
THRESHOLD = 0.3
SLICE = 8 << 20  # text bytes featurised at once: running sums take a few 8-byte numbers per byte

FEATURES = ["log_chars", "log_words", "word_length", "upper", "digit", "space", "symbol", "non_ascii", "distinct_words", "top_word",
            "short_words", "long_words", "repeated_lines", "line_length", "ended_lines", "symbol_words", "same_next_word", "capital_words", "bars", "exclaims"]

_CLASS = np.zeros(256, np.uint8)  # bits: 1 upper, 2 digit, 4 white space, 8 symbol, 16 beyond ASCII, 32 bar, 64 exclamation
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
for _c in range(33, 127):
    if not chr(_c).isalnum() and chr(_c) not in ".,;:'\"-?()":
        _CLASS[_c] |= 8
_CLASS[128:] = 16
_CLASS[ord("|")] |= 32
_CLASS[ord("!")] |= 64


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``values`` between ``starts`` (n + 1); empty runs are 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def _repeats(group: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, and the count of the commonest, per group."""
    if not len(code):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    key = np.sort((group.astype(np.int64) << 32) | code)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.flatnonzero(new)
    owner = (key[first] >> 32).astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner, np.diff(np.concatenate([first, [len(key)]])))
    return np.bincount(owner, minlength=n), most


def text_features(texts: pa.Array) -> np.ndarray:
    """(texts, features) in the order of FEATURES."""
    n = len(texts)
    if n == 0:
        return np.zeros((0, len(FEATURES)))
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[starts[0]:starts[-1]]
    starts = starts - starts[0]
    kind = _CLASS[raw]
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.maximum(np.diff(starts), 1).astype(np.float64)
    share = {bit: _sums((kind & bit) > 0, starts) / size for bit in (1, 2, 4, 8, 16, 32, 64)}
    lists = pc.ascii_split_whitespace(texts)
    per = list_lengths(lists)
    codes, distinct = codes_of(lists.flatten())
    owner = np.repeat(np.arange(n), per)
    length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64) if len(distinct) else np.zeros(0, np.int64)
    ends = starts_of(per)
    words = np.maximum(per, 1).astype(np.float64)
    unique, most = _repeats(owner, codes, n)
    marked = pc.match_substring_regex(distinct, "[#$%&*|!<>{}=_~^@+]").to_numpy(zero_copy_only=False) if len(distinct) else np.zeros(0, bool)
    capital = pc.match_substring_regex(distinct, "^[A-ZÀ-ÖØ-Þ]{2,}[^a-zß-öø-ÿ]*$").to_numpy(zero_copy_only=False) if len(distinct) else np.zeros(0, bool)
    same = np.zeros(len(codes), np.int64)
    if len(codes) > 1:
        same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    lines = pc.split_pattern(texts, "\n")
    per_line = list_lengths(lines)
    flat = lines.flatten()
    line_codes, line_distinct = codes_of(flat)
    line_owner = np.repeat(np.arange(n), per_line)
    unique_lines, _ = _repeats(line_owner, line_codes, n)
    ended = pc.match_substring_regex(line_distinct, "[.!?:;\"')]\\s*$").to_numpy(zero_copy_only=False)[line_codes]
    n_lines = np.maximum(per_line, 1).astype(np.float64)
    return np.stack([
        np.log1p(chars), np.log1p(per), _sums(length[codes], ends) / words, share[1], share[2], share[4], share[8], share[16],
        unique / words, most / words, _sums(length[codes] <= 2, ends) / words, _sums(length[codes] > 12, ends) / words,
        1 - unique_lines / n_lines, np.log1p(chars / n_lines), _sums(ended, starts_of(per_line)) / n_lines,
        _sums(marked[codes], ends) / words, _sums(same, ends) / words, _sums(capital[codes], ends) / words, share[32], share[64]], axis=1)


def _features(batches):
    for t in gathered(batches, limit=SLICE):
        x = text_features(large(t.column("text"))).astype(np.float32)
        yield record_batch({"label": one_array(t.column("label")), "x": pa.ListArray.from_arrays(
            pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))})


@dataclass
class Additive:
    """Lookup tables over binned features and pairs of them."""

    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    mains: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # bin -> coarse bin, for pairs
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(np.nan_to_num(x))
        z = np.full(len(x), self.base)
        for f, t in enumerate(self.mains):
            z += t[b[:, f]]
        for f, g, t in self.pairs:
            z += t[self.coarse[f][b[:, f]], self.coarse[g][b[:, g]]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A shallow regression tree over ordered bins: the best splits, one at a time, as a table of Newton steps."""
    cuts = [0, len(grad)]
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1:
                c = np.arange(a + 1, b)
                gain = worth(a, c) + worth(c, b) - worth(a, b)
                if gain.max() > best[0]:
                    best = (gain.max(), int(c[gain.argmax()]))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(grad))
    for a, b in zip(cuts[:-1], cuts[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _corner(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best tree of one split on either feature: (gain, table of the four corners' steps)."""
    g, h = (np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for a in (grad, hess))
    i, j = np.meshgrid(np.arange(1, grad.shape[0]), np.arange(1, grad.shape[1]), indexing="ij")
    if not i.size:
        return 0.0, np.zeros_like(grad)
    parts = []
    for a in (g, h):
        low, left, top, all_ = a[i, j], a[i, -1], a[-1, j], a[-1, -1]
        parts.append((low, left - low, top - low, all_ - left - top + low))
    gain = sum(p ** 2 / (q + ridge) for p, q in zip(*parts))
    at = np.unravel_index(gain.argmax(), gain.shape)
    step = [p[at] / (q[at] + ridge) for p, q in zip(*parts)]
    out = np.empty_like(grad)
    a, b = at[0] + 1, at[1] + 1
    out[:a, :b], out[:a, b:], out[a:, :b], out[a:, b:] = step
    return float(gain.max() - g[-1, -1] ** 2 / (h[-1, -1] + ridge)), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.1, n_pairs: int = 6, pair_rounds: int = 40, leaves: int = 3, ridge: float = 5.0) -> Additive:
    """Cyclic boosting of the logistic loss: main effects first, then the strongest pairs."""
    model = Additive()
    share = float(y.mean()) if len(y) else 0.5
    model.base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if not len(y) or not 0 < share < 1:
        return model
    x = np.nan_to_num(x)
    model.edges = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) for f in range(x.shape[1])]
    b = model.bins(x)
    size = [len(e) + 1 for e in model.edges]
    model.mains = [np.zeros(s) for s in size]
    z = np.full(len(y), model.base)
    for _ in range(rounds):
        for f in range(x.shape[1]):
            p = 1 / (1 + np.exp(-z))
            step = rate * _tree(np.bincount(b[:, f], y - p, size[f]), np.bincount(b[:, f], p * (1 - p), size[f]), leaves, ridge)
            model.mains[f] += step
            z += step[b[:, f]]
    model.coarse = [np.arange(s) * 8 // max(s, 8) if s > 8 else np.arange(s) for s in size]
    c = np.stack([m[b[:, f]] for f, m in enumerate(model.coarse)], axis=1)
    wide = [int(m.max()) + 1 for m in model.coarse]

    def grid(f, g, w):
        return np.bincount(c[:, f] * wide[g] + c[:, g], w, wide[f] * wide[g]).reshape(wide[f], wide[g])

    p = 1 / (1 + np.exp(-z))
    found = sorted(((_corner(grid(f, g, y - p), grid(f, g, p * (1 - p)), ridge)[0], f, g) for f in range(x.shape[1]) for g in range(f)), reverse=True)
    model.pairs = [(f, g, np.zeros((wide[f], wide[g]))) for _, f, g in found[:n_pairs]]
    for _ in range(pair_rounds):
        for f, g, t in model.pairs:
            p = 1 / (1 + np.exp(-z))
            step = rate * _corner(grid(f, g, y - p), grid(f, g, p * (1 - p)), ridge)[1]
            t += step
            z += step[c[:, f], c[:, g]]
    return model


def is_held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> Additive:
    """Fit on labelled rows outside the held-out fifth; at most ``sample`` ids, by smallest hash.

    The sample is drawn from ids alone, so only its own texts are featurised
    here; its ids are at most ``sample`` and are broadcast. An id with several
    texts counts with its smallest.
    """
    known = (labels.select(F.col("doc_id"), F.col(f"`{label_col}`").alias("label")).where("doc_id is not null and label is not null")
             .groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label")).where(~is_held_out()))
    chosen = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label")
    rows = arrow_map(texts, _features, "label int, x array<float>").toArrow()
    x = np.asarray(rows.column("x").combine_chunks().flatten(), dtype=np.float64).reshape(-1, len(FEATURES)) if rows.num_rows else np.zeros((0, len(FEATURES)))
    y = np.asarray(rows.column("label"), dtype=np.float64)
    order = np.lexsort((*x.T, y))  # sums in one order, however the rows arrive
    return fit(x[order], y[order])


def _scores(model: Additive, texts: pa.Array) -> np.ndarray:
    return model.score(text_features(texts).astype(np.float32).astype(np.float64))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``df``."""
    docs = texts_of(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    model = train(docs, labels)

    def run(batches):
        for t in gathered(batches, limit=SLICE):
            yield record_batch({"doc_id": one_array(t.column("doc_id")), "score": pa.array(_scores(model, large(t.column("text"))), pa.float64())})
    scored = arrow_map(docs, run, f"doc_id {kind}, score double")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, all columns, whose text scores at least ``threshold``."""
    model = train(texts_of(df, "doc_id", text_col), labels)
    names, spot = df.columns, df.columns.index(text_col)
    base = df.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches):
        for b in slices(batches, f"c{spot}", SLICE):
            yield b.filter(pa.array(_scores(model, pc.fill_null(b.column(spot).cast(pa.large_string()), "")) >= threshold))
    return arrow_map(base, run, base.schema, batch_bytes=SLICE).toDF(*names)

"""Masked-language-model data preparation: vocabulary, tokenize-truncate-pad,
seeded 80/10/10 masking.

:func:`build_vocab` and :func:`encode` work on whole words: a vocabulary counted in the
corpus, or supplied as ``(token, id)``. Subword ids come from :mod:`wordpiece`. Ids 0-4
are the special tokens below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import get_tokenizer, is_blank
from .select import dense_index

# Special-token ids of the word-level vocabulary.
PAD, UNK, CLS, SEP, MASK = 0, 1, 2, 3, 4
N_SPECIAL = 5
IGNORE_INDEX = -100
# Vocabularies up to this size are ranked with one ordered limit.
SMALL_VOCAB = 1_000_000


def pick_text_column(df: DataFrame) -> str:
    """``contents`` if present, else the first column (P10)."""
    return "contents" if "contents" in df.columns else df.columns[0]


def build_vocab(df: DataFrame, text_col: str = "text", tokenizer: str = "wordpunct",
                max_size: int | None = 30000, tokens_col: str | None = None) -> DataFrame:
    """``(token, id)``: tokens by frequency (ties by token), ids after the specials.

    Counting is a partial-aggregated groupBy; ranking uses the distributed
    dense index (no single-partition window). ``max_size`` keeps the most
    frequent tokens (the vocabulary size is the feature being set).
    ``tokens_col`` takes already tokenized text (tokenize once, feed both
    this and :func:`encode`).
    """
    toks = F.col(tokens_col) if tokens_col else get_tokenizer(tokenizer)(F.col(text_col))
    counts = df.select(F.explode(toks).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("freq"))
    counts = counts.withColumn("neg_freq", -F.col("freq"))
    if max_size is not None and max_size <= SMALL_VOCAB:
        # bounded by the parameter: one ordered limit, then a window over <= max_size rows
        top = counts.orderBy("neg_freq", "token").limit(max_size)
        idx = top.withColumn("id", F.row_number().over(Window.orderBy("neg_freq", "token")) - 1 + N_SPECIAL)
    else:
        idx = dense_index(counts, ["neg_freq", "token"], "id", start=N_SPECIAL)
        if max_size is not None:
            idx = idx.where(F.col("id") < F.lit(N_SPECIAL + max_size))
    return idx.select("token", F.col("id").cast("int").alias("id"), "freq")


def encode(df: DataFrame, vocab: DataFrame, max_length: int = 128, id_col: str = "doc_id",
           text_col: str = "text", tokenizer: str = "wordpunct", tokens_col: str | None = None,
           pair_col: str | None = None) -> DataFrame:
    """Tokenise, map to ids, truncate to ``max_length`` with [CLS]/[SEP], pad.

    Output: ``input_ids, attention_mask, special_tokens_mask`` (ARRAY<INT>); with
    ``pair_col`` both texts of a row, ``[CLS] a [SEP] b [SEP]``, and ``token_type_ids``.
    A pair that is too long loses tokens from its longer text. Blank texts are
    dropped first (P9). A vocabulary of at most ``SMALL_VOCAB`` counted rows is
    shipped to the tasks, which move no row; a larger one is joined.
    """
    tok = get_tokenizer(tokenizer)
    if tokens_col:
        # a non-blank text always has at least one token, so blank == no tokens
        rows = df.where(F.size(F.col(tokens_col)) > 0).select(F.col(id_col).alias("doc_id"), F.col(tokens_col).alias("_t"))
    else:
        cols = [F.col(id_col).alias("doc_id"), tok(F.col(text_col)).alias("_t")]
        if pair_col:
            cols.append(tok(F.coalesce(F.col(pair_col), F.lit(""))).alias("_u"))
        rows = df.where(~is_blank(F.col(text_col))).select(*cols)
    cols = ["_t", "_u"] if pair_col else ["_t"]
    return _padded(_lookup(_cut(rows, max_length, *cols), vocab, cols), max_length, *cols)


def fit_ids(rows: DataFrame, max_length: int, first: str, second: str | None = None) -> DataFrame:
    """:func:`encode`'s output from id arrays of any length (``doc_id``, ``first`` and perhaps ``second``)."""
    return _padded(_cut(rows, max_length, first, second), max_length, first, second)


def _cut(rows: DataFrame, max_length: int, first: str, second: str | None = None) -> DataFrame:
    """Arrays cut to what fits beside [CLS] and [SEP]; of a pair the longer array loses."""
    if second is None:
        return rows.select("doc_id", F.slice(first, 1, max_length - 2).alias(first))
    body = max_length - 3
    la, lb, half = F.size(first), F.size(second), F.lit((body + 1) // 2)
    keep = F.when(la + lb <= body, la).when(la <= half, la).when(lb <= body - half, F.lit(body) - lb).otherwise(half)
    return rows.withColumn("_keep", keep).select("doc_id", F.slice(first, F.lit(1), F.col("_keep")).alias(first),
                                                 F.slice(second, F.lit(1), F.lit(body) - F.col("_keep")).alias(second))


def _padded(rows: DataFrame, max_length: int, first: str, second: str | None = None) -> DataFrame:
    cols = _pad_columns(F.col(first), max_length) if second is None else _pair_columns(F.col(first), F.col(second), max_length)
    return rows.select("doc_id", *cols)


def _lookup(rows: DataFrame, vocab: DataFrame, cols: list[str]) -> DataFrame:
    """Token arrays -> id arrays, [UNK] where the vocabulary lacks a token."""
    import pyarrow as pa
    import pyarrow.compute as pc

    known = vocab.select("token", "id").limit(SMALL_VOCAB + 1).toArrow()
    if known.num_rows > SMALL_VOCAB:
        return _lookup_joined(rows, vocab, cols)
    spark = rows.sparkSession
    from ..session import ship_package
    ship_package(spark)
    shipped = spark.sparkContext.broadcast((known.column("token").combine_chunks(), known.column("id").combine_chunks()))

    def fn(batches):
        tokens, ids = shipped.value
        for rb in batches:
            out = [rb.column(0)]
            for lists in rb.columns[1:]:
                place = pc.index_in(lists.flatten().cast(tokens.type), value_set=tokens)
                found = pc.fill_null(ids.take(place), UNK).cast(pa.int32())
                size = pc.fill_null(pc.list_value_length(lists), 0)
                ends = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(size).cast(pa.int32())])
                out.append(pa.ListArray.from_arrays(ends, found))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", *cols])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", *cols).mapInArrow(fn, f"doc_id {kind}, " + ", ".join(f"{c} array<int>" for c in cols))


def _lookup_joined(rows: DataFrame, vocab: DataFrame, cols: list[str]) -> DataFrame:
    """The same by a join, for vocabularies too large to ship; a token counts once per row and place."""
    out = None
    for c in cols:
        spread = rows.select("doc_id", F.posexplode_outer(c).alias("pos", "token"))
        j = spread.join(vocab.select("token", "id"), "token", "left").select(
            "doc_id", F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(UNK)).alias("id"))).alias("_p"))
        ids = j.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("_p")), lambda s: s["id"]).alias(c))
        out = ids if out is None else out.join(ids, "doc_id")
    return out


def _pad_columns(ids: Column, max_length: int) -> list[Column]:
    n = F.size(ids)
    pad_n = F.lit(max_length - 2) - n
    input_ids = F.concat(F.array(F.lit(CLS)), ids, F.array(F.lit(SEP)), F.array_repeat(F.lit(PAD), pad_n))
    att = F.concat(F.array_repeat(F.lit(1), n + 2), F.array_repeat(F.lit(0), pad_n))
    spec = F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), n), F.array(F.lit(1)), F.array_repeat(F.lit(1), pad_n))
    return [input_ids.alias("input_ids"), att.alias("attention_mask"), spec.alias("special_tokens_mask")]


def _pair_columns(a: Column, b: Column, max_length: int) -> list[Column]:
    n, m = F.size(a), F.size(b)
    pad = F.lit(max_length - 3) - n - m
    zero = lambda k: F.array_repeat(F.lit(0), k)
    one = lambda k: F.array_repeat(F.lit(1), k)
    input_ids = F.concat(F.array(F.lit(CLS)), a, F.array(F.lit(SEP)), b, F.array(F.lit(SEP)), F.array_repeat(F.lit(PAD), pad))
    return [input_ids.alias("input_ids"), F.concat(zero(n + 2), one(m + 1), zero(pad)).alias("token_type_ids"),
            F.concat(one(n + m + 3), zero(pad)).alias("attention_mask"),
            F.concat(F.array(F.lit(1)), zero(n), F.array(F.lit(1)), zero(m), F.array(F.lit(1)), one(pad)).alias("special_tokens_mask")]


def mask_tokens(df: DataFrame, vocab_size: int, seed: int = 0, mlm_probability: float = 0.15,
                id_col: str = "doc_id", init_labels: str | None = None) -> DataFrame:
    """Seeded MLM masking.

    Each non-special position is selected with probability 0.15; selected
    positions become [MASK] (80%), a random id (half of the rest) or stay.
    ``labels`` = original id at selected positions, -100 elsewhere; with
    ``init_labels``, positions already holding [MASK] take the given label.
    All four draws for a position come from one sha-256 of
    ``seed:mlm:id:position`` (four 13-hex-digit uniforms).
    """
    def u(h: Column, k: int) -> Column:
        return (F.conv(F.substring(h, 13 * k + 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4503599627370496.0)

    def digest(i: Column) -> Column:
        return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit("mlm"), F.col(id_col).cast("string"), i.cast("string")), 256)

    zipped = F.arrays_zip(F.col("input_ids").alias("x"), F.col("special_tokens_mask").alias("s"))
    info = F.transform(zipped, lambda z, i: F.struct(
        z["x"].alias("x"), z["s"].alias("s"), digest(i).alias("h")))
    sel = lambda e: (e["s"] == 0) & (u(e["h"], 0) < F.lit(mlm_probability))
    # one digest per position, computed once and read by both outputs
    df = df.withColumn("_info", info)
    info = F.col("_info")
    new_ids = F.transform(info, lambda e: F.when(~sel(e), e["x"])
                          .when(u(e["h"], 1) < F.lit(0.8), F.lit(MASK))
                          .when(u(e["h"], 2) < F.lit(0.5), F.floor(u(e["h"], 3) * F.lit(vocab_size)).cast("int"))
                          .otherwise(e["x"]))
    labels = F.transform(info, lambda e: F.when(sel(e), e["x"]).otherwise(F.lit(IGNORE_INDEX)))
    out = df.withColumn("labels", labels)
    if init_labels is not None:
        out = out.withColumn("labels", F.transform(
            F.arrays_zip(F.col("input_ids").alias("x0"), F.col("labels").alias("l"), F.col(init_labels).alias("il")),
            lambda z: F.when(z["x0"] == F.lit(MASK), z["il"]).otherwise(z["l"])))
    return out.withColumn("input_ids", new_ids).drop("_info")

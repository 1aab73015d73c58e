"""Relevance-classifier path: labelled lines, positional mixing, ordered
splits, a Spark ML classifier, batch prediction, metrics and retrieval.

The reference trains a fastText model; here the same role is played by a
``pyspark.ml`` pipeline (hashed unigram+bigram counts -> logistic
regression), tuned on the validation split.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import treebank_tokens
from ..functions.text import WHITESPACE_CLASS
from .select import dense_index, pareto_select, top_k

LABEL_PREFIX = "__label__"


def classifier_line(label: Column, text: Column) -> Column:
    """``__label__{y} , {treebank tokens of lower(text) joined by one space}``."""
    return F.concat(F.lit(LABEL_PREFIX), label.cast("string"), F.lit(" , "),
                    F.array_join(treebank_tokens(text), " "))


def relabel(line: Column, label) -> Column:
    """Swap the label of a line: drop its first two tokens, keep the rest."""
    toks = F.filter(F.split(line, WHITESPACE_CLASS + "+"), lambda x: x != F.lit(""))
    rest = F.array_join(F.slice(toks, 3, F.greatest(F.size(toks) - 2, F.lit(0))), " ")
    lab = label if isinstance(label, Column) else F.lit(str(label))
    return F.concat(F.lit(LABEL_PREFIX), lab.cast("string"), F.lit(" , "), rest)


def label_of(line: Column) -> Column:
    return F.regexp_extract(line, r"^__label__(\S+)", 1)


def ordered_split(df: DataFrame, order_cols: Sequence[str], frac: float = 0.9) -> DataFrame:
    """First ``int(frac * n)`` rows in order -> ``train``, the rest -> ``val``."""
    n = df.count()
    n_train = int(n * frac)
    idx = dense_index(df, list(order_cols), "_pos")
    return idx.withColumn("split", F.when(F.col("_pos") < F.lit(n_train), F.lit("train")).otherwise(F.lit("val")))


def zip_mix(pos: DataFrame, neg: DataFrame, pos_order: Sequence[str], neg_order: Sequence[str],
            line_col: str | Column = "line", frac: float = 0.9) -> DataFrame:
    """Interleave target (label 1) and background (label 0) lines by position.

    Line i of each side form pair i; the longer side is cut to the shorter;
    the first ``int(0.9 * pairs)`` pairs are training rows, the rest validation.
    ``line_col`` is a column of both sides or an expression over their columns; it is
    evaluated for the rows of the pairs alone. Output: ``split, pair, label, line``.
    """
    line = F.col(line_col) if isinstance(line_col, str) else line_col
    n = min(pos.count(), neg.count())
    n_train = int(n * frac)

    def numbered(side, order, name):
        # positions come from the ordering columns alone; lines are made for the rows that stay
        keys = dense_index(side.select(*order), list(order), "pair").where(F.col("pair") < F.lit(n))
        return side.join(keys, list(order)).select("pair", line.alias(name))
    p, q = numbered(pos, pos_order, "p"), numbered(neg, neg_order, "q")
    j = p.join(q, "pair")
    both = j.select("pair", F.explode(F.array(
        F.struct(F.lit(1).alias("label"), relabel(F.col("p"), 1).alias("line")),
        F.struct(F.lit(0).alias("label"), relabel(F.col("q"), 0).alias("line")))).alias("r"))
    return both.select(F.when(F.col("pair") < F.lit(n_train), F.lit("train")).otherwise(F.lit("val")).alias("split"),
                       "pair", F.col("r.label").alias("label"), F.col("r.line").alias("line"))


def train_classifier(train: DataFrame, val: DataFrame | None = None, text_col: str = "text",
                     label_col: str = "label", num_features: int = 1 << 18, ngrams: int = 2,
                     reg_params: Sequence[float] = (0.0, 0.01, 0.1), max_iter: int = 50,
                     word_vectors: DataFrame | None = None, tokens_col: str | None = None):
    """Hashed n-gram logistic regression, tuned on ``val`` if given.

    ``word_vectors`` ``(word, vec)`` adds the mean word vector of each text as
    extra features (joined per token, averaged per document). ``tokens_col``
    takes Treebank-style tokens computed once by the caller.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import HashingTF, NGram, SQLTransformer, VectorAssembler

    def prep(df):
        out = df.withColumn("_tok", F.col(tokens_col) if tokens_col else treebank_tokens(F.col(text_col)))
        if word_vectors is not None:
            out = add_mean_vector(out, word_vectors)
        return out

    sizes = range(2, ngrams + 1)
    stages = [*[NGram(n=i, inputCol="_tok", outputCol=f"_gram{i}") for i in sizes],
              SQLTransformer(statement=f"SELECT *, concat({', '.join(['_tok', *[f'_gram{i}' for i in sizes]])}) AS _grams FROM __THIS__"),
              HashingTF(numFeatures=num_features, inputCol="_grams", outputCol="_tf")]
    feat = "_tf"
    if word_vectors is not None:
        stages.append(VectorAssembler(inputCols=["_tf", "_wv"], outputCol="_feat"))
        feat = "_feat"
    from pyspark.ml import PipelineModel
    # stateless featurisation, computed once and kept for the optimiser's passes
    feat_model = Pipeline(stages=stages).fit(prep(train.limit(0)))
    lr = LogisticRegression(featuresCol=feat, labelCol=label_col, maxIter=max_iter)
    tr = feat_model.transform(prep(train).withColumn(label_col, F.col(label_col).cast("double"))) \
        .select(feat, label_col).persist()
    va = None
    if val is not None and len(reg_params) > 1:
        va = feat_model.transform(prep(val).withColumn(label_col, F.col(label_col).cast("double"))) \
            .select(feat, label_col).persist()
    try:
        if va is None:
            lr.setRegParam(reg_params[0] if reg_params else 0.0)
            best = lr.fit(tr)
        else:
            ev = BinaryClassificationEvaluator(labelCol=label_col, rawPredictionCol="rawPrediction")
            best, best_score = None, None
            for rp in reg_params:
                lr.setRegParam(rp)
                model = lr.fit(tr)
                score = ev.evaluate(model.transform(va))
                if best_score is None or score > best_score:
                    best, best_score = model, score
    finally:
        tr.unpersist()
        if va is not None:
            va.unpersist()
    return PipelineModel(stages=list(feat_model.stages) + [best])


def add_mean_vector(df: DataFrame, word_vectors: DataFrame, tok_col: str = "_tok",
                    id_col: str = "doc_id") -> DataFrame:
    """Mean of the word vectors of a document's tokens as ``_wv``."""
    from pyspark.ml.functions import array_to_vector
    dim = len(word_vectors.first()["vec"])
    # a word counts once per document, with its number of occurrences: stop words do not multiply rows
    times = df.select(id_col, F.explode(tok_col).alias("word")).groupBy(id_col, "word").agg(F.count(F.lit(1)).cast("double").alias("c"))
    j = times.join(word_vectors.select("word", F.col("vec").cast("array<double>").alias("vec")), "word")
    place = [(F.sum(F.col("vec")[i] * F.col("c")) / F.sum("c")) for i in range(dim)]
    arr = j.groupBy(id_col).agg(F.array(*place).alias("_wva"))
    out = df.join(arr, id_col, "left")
    zero = F.array_repeat(F.lit(0.0), dim)
    return out.withColumn("_wv", array_to_vector(F.coalesce("_wva", zero))).drop("_wva")


def predict_proba(model, df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                  word_vectors: DataFrame | None = None, tokens_col: str | None = None) -> DataFrame:
    """Positive-class probability for every row."""
    from pyspark.ml.functions import vector_to_array
    x = df.withColumn("_tok", F.col(tokens_col) if tokens_col else treebank_tokens(F.col(text_col)))
    if word_vectors is not None:
        x = add_mean_vector(x, word_vectors)
    out = model.transform(x)
    return out.select(id_col, vector_to_array("probability")[1].alias("prob"))


def positive_prob(top_label: Column, top_p: Column) -> Column:
    """From a (top label, its probability) pair: label 0 -> 1 - p, else p."""
    return F.when(top_label == 0, F.lit(1.0) - top_p).otherwise(top_p)


def binary_metrics(df: DataFrame, pred_col: str = "pred", label_col: str = "label") -> DataFrame:
    """Precision, recall, F1 and accuracy of 0/1 predictions (A8), one row."""
    p, y = F.col(pred_col).cast("int"), F.col(label_col).cast("int")
    c = df.agg(F.sum(((p == 1) & (y == 1)).cast("long")).alias("tp"),
               F.sum(((p == 1) & (y == 0)).cast("long")).alias("fp"),
               F.sum(((p == 0) & (y == 1)).cast("long")).alias("fn"),
               F.sum(((p == 0) & (y == 0)).cast("long")).alias("tn"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    out = c.select("tp", "fp", "fn", "tn", prec.alias("precision"), rec.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))) \
        .otherwise(F.lit(0.0))
    acc = (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return out.select("tp", "fp", "fn", "tn", "precision", "recall", f1.alias("f1"), acc.alias("accuracy"))


def retrieve(scores: DataFrame, k: int, mode: str = "pareto", prob_col: str = "prob", seed: int = 0,
             id_col: str = "doc_id") -> DataFrame:
    """Choose k rows by classifier probability: ``topk`` (K6) or ``pareto`` (K5).

    k larger than the pool keeps the whole pool (K8).
    """
    if mode == "topk":
        return top_k(scores, k, prob_col, id_col)
    if mode == "pareto":
        return pareto_select(scores, k, prob_col, seed=seed, id_col=id_col)
    raise ValueError(f"unknown retrieval mode {mode!r}: use topk or pareto")

"""Learned abbreviations, sentence ends and the tokens that follow from them."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpus_select.operators import sentences as se
from conftest import SF001, text_df

NAMES = ["Smith", "Jones", "Brown", "Miller", "Davis", "Clark", "Lewis", "Young"]
NOUNS = ["report", "house", "market", "river", "letter", "garden", "number", "window", "picture", "answer"]


def corpus():
    """Sentences in which dr, e.g. and u.s. carry periods and ordinary words end sentences."""
    out = []
    for i in range(400):
        a, b, c = NAMES[i % 8], NOUNS[i % 10], NOUNS[(i * 3 + 1) % 10]
        out.append([f"The {b} of Dr. {a} was here. However the {c} was not.", f"We saw a {b}, e.g. the {c} near the {b}. It was old.", f"The U.S. {b} grew. The {c} fell!",
                    f"Is the {c} there? The {b} is.", f"The old {b} that grew here was not there and is not here now. However it grew old later. However the old {c} is here."][i % 5])
    return out


@pytest.fixture(scope="module")
def model(spark):
    return se.fit_sentences(text_df(spark, corpus()).repartition(5))


def brute_scores(texts):
    n, periods = Counter(), Counter()
    for text in texts:
        for w in text.lower().split():
            core = re.sub(r"[^\w.]+$", "", re.sub(r"^\W+", "", w))
            kind = re.sub(r"\.+$", "", core)
            if kind:
                kind = se.NUMBER if re.match(r"^[0-9][0-9.,]*$", kind) else kind
                n[kind] += 1
                periods[kind] += bool(re.search(r"[^.]\.$", core))
    share = sum(periods.values()) / sum(n.values())
    out = {}
    for kind, p in periods.items():
        if not p or kind == se.NUMBER or not re.search("[^\\W\\d]", kind):
            continue
        without, inner = n[kind] - p, kind.count(".")
        letters = len(kind) - inner
        any_ = p * math.log(share) + (without * math.log(1 - share) if without else 0)
        always = p * math.log(0.99) + without * math.log(0.01)
        out[kind] = (n[kind], p, -2 * (any_ - always) * math.exp(-letters) * (inner + 1) * letters ** -without)
    return out


def test_scores_against_plain_python(spark):
    texts = [*corpus(), "3.5 percent. 7. x", "", None, "(Mr.) \"etc.\", end."]
    found = {r.type: (r.n, r.n_period, r.score) for r in se.abbreviation_scores(se.word_counts(text_df(spark, texts).repartition(3))).collect()}
    want = brute_scores([t for t in texts if t])
    assert found.keys() == want.keys()
    for k, v in want.items():
        assert found[k][:2] == v[:2] and found[k][2] == pytest.approx(v[2], rel=1e-9, abs=1e-12)


def test_patterns_run_on_distinct_words(spark):
    # occurrences are counted as written before any pattern: the plan aggregates words below the patterns
    counted = se.word_counts(text_df(spark, ["Dr. Dr. dr (dr.) 7 7. ...", None, ""]).repartition(3))
    assert {(r.type, r.n, r.n_period) for r in counted.collect()} == {("dr", 4, 3), (se.NUMBER, 2, 1)}
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and plan.rindex("Aggregate [w#") > plan.index("regexp_replace")


def test_words_are_made_once_per_text(spark):
    df = text_df(spark, ["a b. c"]).select(se.sentence_tokens(F.col("text"), se.SentenceModel()).alias("t"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("array_remove") == 1


def test_abbreviations_and_starters(model):
    assert {"dr", "e.g", "u.s"} <= model.abbreviations and not model.abbreviations & set(NOUNS)
    assert {"the", "however", "it"} & model.starters and not model.starters & {n.lower() for n in NAMES}


def tokens(spark, model, text, cased=False):
    return text_df(spark, [text]).select(se.sentence_tokens(F.col("text"), model, cased).alias("t")).first().t


def test_tokens_keep_inner_abbreviations(spark, model):
    assert tokens(spark, model, "Dr. Smith saw the U.S. market, e.g. the house. It fell.") == \
        ["dr.", "smith", "saw", "the", "u.s.", "market", ",", "e.g.", "the", "house", ".", "it", "fell", "."]
    assert tokens(spark, model, "We met Dr.") == ["we", "met", "dr", "."]  # the text's end is a sentence's
    assert tokens(spark, model, "J. Smith has 3. It") == ["j.", "smith", "has", "3.", "it"]  # initials and numbers
    assert tokens(spark, model, "(the house.) Then \"the river.\" And") == ["(", "the", "house", ".", ")", "then", "``", "the", "river", ".", "''", "and"]
    assert tokens(spark, model, "wait ... what? yes!") == ["wait", "...", "what", "?", "yes", "!"]
    assert tokens(spark, model, "") == [] and tokens(spark, model, "  \n ") == []
    null = spark.createDataFrame([(None,)], "text string").select(se.sentence_tokens("text", model).alias("t")).first().t
    assert null is None or null == []


def test_cased_starters_end_a_sentence_after_an_abbreviation(spark, model):
    assert tokens(spark, model, "He left the U.S. However it rained.", cased=True)[3:6] == ["u.s", ".", "however"]
    assert tokens(spark, model, "He left the U.S. market again.", cased=True)[3] == "u.s."


def test_sentences(spark, model):
    rows = text_df(spark, ["Dr. Smith came. The U.S. market\nfell! Was it e.g. the house? Yes", ""]).select("doc_id", se.sentences(F.col("text"), model).alias("s")).collect()
    assert {r.doc_id: r.s for r in rows} == {0: ["Dr. Smith came.", "The U.S. market fell!", "Was it e.g. the house?", "Yes"], 1: []}


def test_without_a_model_only_ends_and_breaks_are_split(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").limit(40).collect()]
    df = text_df(spark, [re.sub(r"\b\w\.|\d", "x", t or "") for t in texts])
    rows = df.select(se.sentence_tokens(F.col("text"), se.SentenceModel()).alias("a"), se.treebank_tokens(F.array_join(se.words(F.col("text")), " ")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_association_and_collocations(spark):
    texts = ["see no. 7 and no. seven again " * 3, "vol. ix vol. ix vol. ix vol. ix"] * 20 + [f"ordinary {n} here. More {m} there." for n in NOUNS for m in NOUNS]
    model = se.fit_sentences(text_df(spark, texts))
    assert "vol ix" in model.collocations
    with pytest.MonkeyPatch.context() as m:
        m.setattr(se, "MAX_WORDS", 1)
        with pytest.raises(ValueError):
            se.fit_sentences(text_df(spark, texts))


def test_fit_of_nothing(spark):
    assert se.fit_sentences(text_df(spark, [""])) == se.SentenceModel()

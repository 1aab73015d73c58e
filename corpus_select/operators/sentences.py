"""Sentence ends learned from a corpus, and word tokens that respect them.

The Treebank rules split a word's final period off only at the end of a sentence. Which
periods end one is learned without labels, by the published log-likelihood tests on counts
(Kiss and Strunk, 2006): a word is an abbreviation if it nearly always carries a period, is
short and has inner periods; a pair across a period is a collocation, and a word is a sentence
starter, if they are seen together far more often than by chance.

Counting is one ``groupBy`` per table over (word, period) or pairs across a period, partially
aggregated, so frequent words cannot skew it. The model is a few word lists. Tokenizing is a
chain of JVM expressions per row: periods that end no sentence are put aside, the rules run
as ever, and the periods come back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import TREEBANK_RULES, treebank_tokens
from ..functions.text import WHITESPACE_CLASS

# Thresholds of the published method and the share of periods an abbreviation has.
ABBREVIATION, COLLOCATION, STARTER, CARRIES = 0.3, 7.88, 30.0, 0.99
MAX_WORDS = 50_000  # a model with more is refused: raise ``min_count``
NUMBER = "##number##"
ASIDE = "\ue000"  # a private character: a period that ends no sentence

# What a word is: from its first letter or digit to its last, with inner marks; patterns that
# the JVM, DuckDB and Python read alike.
HEAD = r"^[^\p{L}\p{N}]+"
TAIL = r"[^\p{L}\p{N}.]+$"
PERIOD = r"[^.]\.$"
LAST_PERIOD = r"\.([^\p{L}\p{N}.]*)$"
ENDED = r"[?!][^\p{L}\p{N}]*$"
NUMERAL = r"^[0-9][0-9.,]*$"
INITIAL = r"^\p{L}$"


def words(text: Column, lower: bool = True) -> Column:
    """Runs of non-space characters of the (lower-cased) text."""
    return F.array_remove(F.split(F.lower(text) if lower else text, WHITESPACE_CLASS + "+"), F.lit(""))


def trimmed(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, HEAD, ""), TAIL, "")


def has_period(word: Column) -> Column:
    """Whether the word, marks around it aside, ends with one period."""
    return trimmed(word).rlike(PERIOD)


def type_of(word: Column) -> Column:
    """The word in lower case without marks around it and without final periods; numbers are one type."""
    core = F.lower(F.regexp_replace(trimmed(word), r"\.+$", ""))
    return F.when(core.rlike(NUMERAL), F.lit(NUMBER)).otherwise(core)


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(type, n, n_period): how often each type occurs, and how often with a final period.

    Occurrences are counted as written first (partially aggregated), so the patterns run once per distinct word.
    """
    seen = df.select(F.explode(words(F.col(text_col))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    w = seen.select(type_of(F.col("w")).alias("type"), "n", F.when(has_period(F.col("w")), F.col("n")).otherwise(F.lit(0).cast("long")).alias("p"))
    return w.where("type <> ''").groupBy("type").agg(F.sum("n").alias("n"), F.sum("p").alias("n_period"))


def abbreviation_scores(counts: DataFrame, min_count: int = 1) -> DataFrame:
    """(type, n, n_period, score) of types seen with a period; ``ABBREVIATION`` and more is one.

    The score is the log-likelihood ratio of "carries a period nearly always" to "as
    often as any word", times exp(-letters), times the number of periods, times
    letters ^ -(occurrences without a period).
    """
    total = counts.agg(F.sum("n").alias("all_n"), F.sum("n_period").alias("all_p"))  # one row
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = (F.length("type") - inner).cast("double")
    without = (F.col("n") - F.col("n_period")).cast("double")
    share = F.col("all_p") / F.col("all_n")
    as_any = F.col("n_period") * F.log(share) + F.when(without > 0, without * F.log(1.0 - share)).otherwise(0.0)
    always = F.col("n_period") * F.log(F.lit(CARRIES)) + without * F.log(F.lit(1.0 - CARRIES))
    score = -2.0 * (as_any - always) * F.exp(-letters) * (inner + 1) * F.exp(-without * F.log(letters))
    seen = counts.where((F.col("n_period") > 0) & (F.col("n") >= min_count) & (F.col("type") != NUMBER) & F.col("type").rlike(r"\p{L}"))
    return seen.crossJoin(F.broadcast(total)).select("type", "n", "n_period", score.alias("score"))


def _likelihood(k: Column, n: Column, p: Column) -> Column:
    """k ln p + (n - k) ln(1 - p), where an absent part counts nothing."""
    return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n > k, (n - k) * F.log(1.0 - p)).otherwise(0.0)


def association(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Log-likelihood ratio that b follows a (seen a times, ``both`` times followed by b) more or less often than elsewhere."""
    p, p1, p2 = b / n, both / a, (b - both) / (n - a)
    return -2.0 * (_likelihood(both, a, p) + _likelihood(b - both, n - a, p) - _likelihood(both, a, p1) - _likelihood(b - both, n - a, p2))


def _neighbours(w: Column, fn) -> Column:
    """``fn(word, next)`` of each word; the last has no next. The words are made once: they are the variable of an outer lambda."""
    return F.get(F.transform(F.array(w), lambda v: F.zip_with(v, F.slice(v, 2, F.greatest(F.size(v), F.lit(1))), fn)), 0)


def _pairs(df: DataFrame, text_col: str) -> DataFrame:
    """(word, next): neighbours of which the first ends with a period, a question or an exclamation mark."""
    both = _neighbours(words(F.col(text_col)), lambda word, after: F.struct(word.alias("word"), after.alias("next")))
    rows = df.select(F.explode(F.filter(both, lambda p: p["next"].isNotNull() & p["word"].rlike(r"[.?!][^\p{L}\p{N}]*$"))).alias("p"))
    return rows.select(type_of(F.col("p.word")).alias("type"), has_period(F.col("p.word")).alias("period"), type_of(F.col("p.next")).alias("next"))


@dataclass(frozen=True)
class SentenceModel:
    """Types that carry a period without ending a sentence, pairs that a period does not part, and words that begin sentences."""
    abbreviations: frozenset[str] = frozenset()
    collocations: frozenset[str] = frozenset()  # "type next"
    starters: frozenset[str] = frozenset()


def _listed(df: DataFrame, what: str) -> frozenset[str]:
    rows = df.limit(MAX_WORDS + 1).toArrow()
    if rows.num_rows > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} {what}: raise min_count")
    return frozenset(rows.column(0).to_pylist())


def fit_sentences(df: DataFrame, text_col: str = "text", min_count: int = 1) -> SentenceModel:
    """Learn the word lists from all texts of ``df``; types and pairs seen fewer than ``min_count`` times are not listed."""
    counts = word_counts(df, text_col).persist()
    try:
        abbreviations = _listed(abbreviation_scores(counts, min_count).where(F.col("score") >= ABBREVIATION).select("type"), "abbreviations")
        pairs = _pairs(df, text_col).groupBy("type", "period", "next").agg(F.count(F.lit(1)).alias("n")).persist()
        try:
            total = counts.agg(F.sum("n")).first()[0] or 0
            abbreviated = _in(F.col("type"), abbreviations)
            loose = abbreviated | F.col("type").rlike(INITIAL) | (F.col("type") == NUMBER)
            follows = counts.select(F.col("type").alias("next"), F.col("n").alias("b"))
            # pairs across the period of what may be an abbreviation
            tied = pairs.where(F.col("period") & loose & (F.col("next") != "")).groupBy("type", "next").agg(F.sum("n").alias("both"))
            tied = tied.where(F.col("both") >= max(min_count, 2)).join(counts.select("type", F.col("n").alias("a")), "type").join(follows, "next")
            ratio = association(F.col("a").cast("double"), F.col("b").cast("double"), F.col("both").cast("double"), F.lit(float(total)))
            more = F.col("both") / F.col("a") > F.col("b") / F.lit(float(max(total, 1)))
            collocations = _listed(tied.where(more & (F.least("a", "b") > 1) & (ratio >= COLLOCATION)).select(F.concat_ws(" ", "type", "next")), "collocations")
            # words after what ends a sentence for sure
            ends = pairs.where(~(F.col("period") & loose) & (F.col("next") != ""))
            breaks = ends.agg(F.sum("n")).first()[0] or 0
            after = ends.groupBy("next").agg(F.sum("n").alias("both")).where(F.col("both") >= max(min_count, 2)).join(follows, "next")
            ratio = association(F.lit(float(breaks)), F.col("b").cast("double"), F.col("both").cast("double"), F.lit(float(total)))
            more = F.col("both") / F.lit(float(max(breaks, 1))) > F.col("b") / F.lit(float(max(total, 1)))
            starters = _listed(after.where(more & (ratio >= STARTER) & F.col("next").rlike(r"^\p{L}")).select("next"), "sentence starters")
        finally:
            pairs.unpersist()
    finally:
        counts.unpersist()
    return SentenceModel(abbreviations, collocations, starters)


def _in(value: Column, listed: frozenset[str]) -> Column:
    return value.isin(sorted(listed)) if listed else F.lit(False)


def ends_sentence(word: Column, following: Column, model: SentenceModel, cased: bool = False) -> Column:
    """Whether a sentence ends between two neighbouring words.

    Abbreviations, initials and numbers with a period do not end one, unless (``cased``) a
    capitalised sentence starter follows; pairs that belong together never do.
    """
    kind, after = type_of(word), type_of(following)
    loose = _in(kind, model.abbreviations) | kind.rlike(INITIAL) | (kind == NUMBER)
    if cased:
        loose = loose & ~(trimmed(following).rlike(r"^\p{Lu}") & _in(after, model.starters) & ~kind.rlike(INITIAL))
    tied = _in(F.concat_ws(" ", kind, after), model.collocations)
    return (has_period(word) & ~loose & ~tied) | word.rlike(ENDED)


def sentence_tokens(text: Column | str, model: SentenceModel, cased: bool = False) -> Column:
    """Treebank-style tokens of the lower-cased text; a period is split off at sentence ends and the text's end alone."""
    w = words(F.col(text) if isinstance(text, str) else text, lower=not cased)

    def put_aside(word: Column, following: Column) -> Column:
        # most words have no period at all: the patterns run for the others
        inner = following.isNotNull() & F.contains(word, F.lit(".")) & has_period(word) & ~ends_sentence(word, following, model, cased)
        return F.when(inner, F.regexp_replace(word, LAST_PERIOD, ASIDE + "$1")).otherwise(word)
    kept = F.array_join(_neighbours(w, put_aside), " ")
    return F.transform(treebank_tokens(kept), lambda t: F.replace(t, F.lit(ASIDE), F.lit(".")))


def sentences(text: Column | str, model: SentenceModel, cased: bool = True) -> Column:
    """The text's sentences, white space between words as one blank."""
    w = words(F.col(text) if isinstance(text, str) else text, lower=False)
    marked = _neighbours(w, lambda word, after: F.concat(word, F.when(F.coalesce(ends_sentence(word, after, model, cased), F.lit(False)), F.lit("\n")).otherwise(F.lit(" "))))
    return F.filter(F.transform(F.split(F.array_join(marked, ""), "\n"), lambda s: F.trim(s)), lambda s: s != F.lit(""))


# -- DuckDB twins -----------------------------------------------------------------

def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '{WHITESPACE_CLASS}+'), lambda x: x <> '')"


def trimmed_sql(word: str) -> str:
    return f"regexp_replace(regexp_replace({word}, '{HEAD}', ''), '{TAIL}', '')"


def type_sql(word: str) -> str:
    core = f"lower(regexp_replace({trimmed_sql(word)}, '\\.+$', ''))"
    return f"case when regexp_matches({core}, '{NUMERAL}') then '{NUMBER}' else {core} end"


def period_sql(word: str) -> str:
    return f"regexp_matches({trimmed_sql(word)}, '{PERIOD}')"


def scores_sql(source: str = "documents", text: str = "text") -> str:
    """CTEs ``wc`` (type, n, n_period) and ``ab`` (type, n, n_period, score)."""
    return f"""wt as (select unnest({words_sql(text)}) w from {source}),
wc as (select type, count(*)::BIGINT n, sum(p)::BIGINT n_period from (select {type_sql('w')} type, ({period_sql('w')})::INT p from wt) where type <> '' group by type),
wa as (select sum(n) all_n, sum(n_period) all_p from wc),
wl as (select *, length(replace(type, '.', ''))::DOUBLE letters, (n - n_period)::DOUBLE bare, all_p / all_n share from wc, wa
  where n_period > 0 and type <> '{NUMBER}' and regexp_matches(type, '\\p{{L}}')),
ab as (select type, n, n_period, -2.0 * (n_period * ln(share) + case when bare > 0 then bare * ln(1.0 - share) else 0.0 end
    - (n_period * ln({CARRIES}) + bare * ln({1.0 - CARRIES}))) * exp(-letters) * (length(type) - letters + 1) * exp(-bare * ln(letters)) score from wl)"""


def tokens_sql(ws: str, abbreviations: str, collocations: str = "[]::VARCHAR[]") -> str:
    """:func:`sentence_tokens` of a column of words, over columns of abbreviations and collocations."""
    kind, after = type_sql(f"{ws}[i]"), type_sql(f"{ws}[i + 1]")
    ends = f"(not (list_contains({abbreviations}, {kind}) or regexp_matches({kind}, '{INITIAL}') or {kind} = '{NUMBER}' or list_contains({collocations}, {kind} || ' ' || {after})))"
    aside = f"i < len({ws}) and {period_sql(f'{ws}[i]')} and not {ends} and not regexp_matches({ws}[i], '{ENDED}')"
    word = f"case when {aside} then regexp_replace({ws}[i], '{LAST_PERIOD}', '{ASIDE}\\1') else {ws}[i] end"
    t = f"lower(array_to_string(list_transform(range(1, len({ws}) + 1), lambda i: {word}), ' '))"
    for pat, rep in TREEBANK_RULES:
        p, r = pat.replace("'", "''"), rep.replace("'", "''")
        for k in range(9, 0, -1):
            r = r.replace(f"${k}", f"\\{k}")
        t = f"regexp_replace({t}, '{p}', '{r}', 'g')"
    return f"list_transform(list_filter(regexp_split_to_array({t}, '{WHITESPACE_CLASS}+'), lambda x: x <> ''), lambda x: replace(x, '{ASIDE}', '.'))"

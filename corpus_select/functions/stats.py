"""Per-document quality statistics as column expressions (no shuffle).

Tokens come from the Treebank-style tokenizer on lower-cased text. The rules
below are kept as data so the Spark expression and the DuckDB twin are
generated from one list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITESPACE_CLASS

# Spark's default English stop words
# (pyspark.ml.feature.StopWordsRemover.loadDefaultStopWords("english")).
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should",
    "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd",
    "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've", "we've",
    "you've", "they've", "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't",
    "doesn't", "didn't", "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't",
    "cannot", "could", "here's", "how's", "let's", "ought", "that's", "there's", "what's", "when's",
    "where's", "who's", "why's", "would",
]
# ASCII punctuation (Python's string.punctuation) and digits.
PUNCTUATION = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
DIGITS = list("0123456789")
UNINFORMATIVE = ENGLISH_STOP_WORDS + PUNCTUATION

# Quality-mask bounds (all strict).
QUALITY_BOUNDS = {
    "length": (40, 500),
    "repeating_ratio": (0.02, 0.2),
    "informative_ratio": (0.3, 0.7),
    "numeric_ratio": (0.8, None),
}

_WS = r"[\t\n\x0B\f\r ]"
# Treebank-style rules, applied in order; "$1" style group references.
TREEBANK_RULES: list[tuple[str, str]] = [
    (r'^"', "`` "),
    (r"(``)", " $1 "),
    (r'([ (\[{<])"', "$1 `` "),
    (r"([:,])([^0-9])", " $1 $2"),
    (r"([:,])\z", " $1 "),
    (r"\.\.\.", " ... "),
    (r"([;@#$%&])", " $1 "),
    (r"([^.])(\.)([\])}>\"']*)(" + _WS + r"|\z)", "$1 $2$3 $4"),
    (r"([?!])", " $1 "),
    (r"([^'])' ", "$1 ' "),
    (r"([\]\[(){}<>])", " $1 "),
    (r"--", " -- "),
    (r'"', " '' "),
    (r"([^' ])('s|'m|'d|') ", "$1 $2 "),
    (r"([^' ])('ll|'re|'ve|n't) ", "$1 $2 "),
]


def treebank_tokens(text: Column | str) -> Column:
    """Treebank-style tokens of lower-cased text, split on Unicode whitespace."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    for pat, rep in TREEBANK_RULES:
        t = F.regexp_replace(t, pat, rep)
    return F.filter(F.split(t, WHITESPACE_CLASS + "+"), lambda x: x != F.lit(""))


def treebank_sql(text: str) -> str:
    """DuckDB twin of :func:`treebank_tokens`."""
    t = f"lower({text})"
    for pat, rep in TREEBANK_RULES:
        p = pat.replace("'", "''")
        r = rep.replace("'", "''")
        for k in range(9, 0, -1):
            r = r.replace(f"${k}", f"\\{k}")
        t = f"regexp_replace({t}, '{p}', '{r}', 'g')"
    return f"list_filter(regexp_split_to_array({t}, '{WHITESPACE_CLASS}+'), lambda x: x <> '')"


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def repeating_ratio(tokens: Column) -> Column:
    """Count of the commonest token / number of tokens; 0 if empty.

    One pass over the sorted tokens tracking the longest run: per row, no shuffle.
    """
    srt = F.array_sort(tokens)
    init = F.struct(F.lit(None).cast("string").alias("p"), F.lit(0).alias("r"), F.lit(0).alias("b"))

    def step(acc, x):
        run = F.when(x == acc["p"], acc["r"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("p"), run.alias("r"), F.greatest(acc["b"], run).alias("b"))
    best = F.aggregate(srt, init, step, lambda acc: acc["b"])
    return _ratio(best, F.size(tokens))


def repeating_top_n_ratio(tokens: Column, n: int = 3) -> Column:
    """Sum of the n largest token counts / number of tokens; 0 if empty.

    One pass over the sorted tokens keeping only the n longest runs seen so
    far (a small fixed-size state), so no (document, token) shuffle is needed.
    """
    srt = F.array_sort(tokens)
    empty = F.array().cast("array<int>")
    init = F.struct(F.lit(None).cast("string").alias("p"), F.lit(0).alias("r"), empty.alias("top"))

    def keep_top(top: Column, run: Column) -> Column:
        return F.slice(F.sort_array(F.concat(top, F.array(run)), asc=False), 1, n)

    def step(acc, x):
        same = x == acc["p"]
        return F.struct(x.alias("p"),
                        F.when(same, acc["r"] + 1).otherwise(F.lit(1)).alias("r"),
                        F.when(same | (acc["r"] == 0), acc["top"]).otherwise(keep_top(acc["top"], acc["r"])).alias("top"))
    total = F.aggregate(srt, init, step,
                        lambda acc: F.aggregate(keep_top(acc["top"], acc["r"]), F.lit(0), lambda a, v: a + v))
    return _ratio(total, F.size(tokens))


def informative_ratio(tokens: Column, uninformative: list[str] | None = None) -> Column:
    """Share of tokens outside stop words and punctuation."""
    stop = uninformative if uninformative is not None else UNINFORMATIVE
    kept = F.filter(tokens, lambda t: ~t.isin(stop))
    return _ratio(F.size(kept), F.size(tokens))


def numeric_ratio(tokens: Column) -> Column:
    """Share of tokens that are NOT a single digit 0-9 (T12; '12' is non-numeric)."""
    kept = F.filter(tokens, lambda t: ~t.isin(DIGITS))
    return _ratio(F.size(kept), F.size(tokens))


def quality_mask(length: str = "length", repeating: str = "repeating_ratio",
                 informative: str = "informative_ratio", numeric: str = "numeric_ratio",
                 bounds: dict | None = None) -> Column:
    """Strict-bounds quality predicate."""
    b = bounds or QUALITY_BOUNDS
    cond = F.lit(True)
    for col, key in ((length, "length"), (repeating, "repeating_ratio"),
                     (informative, "informative_ratio"), (numeric, "numeric_ratio")):
        lo, hi = b[key]
        if lo is not None:
            cond = cond & (F.col(col) > F.lit(lo))
        if hi is not None:
            cond = cond & (F.col(col) < F.lit(hi))
    return cond


def quality_mask_sql(bounds: dict | None = None) -> str:
    b = bounds or QUALITY_BOUNDS
    parts = []
    for key in ("length", "repeating_ratio", "informative_ratio", "numeric_ratio"):
        lo, hi = b[key]
        if lo is not None:
            parts.append(f"{key} > {lo}")
        if hi is not None:
            parts.append(f"{key} < {hi}")
    return " and ".join(parts)


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"

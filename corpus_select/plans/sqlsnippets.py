"""DuckDB SQL fragments for the oracle twins (mirror the Spark expressions)."""

from __future__ import annotations

from ..functions.text import WORDPUNCT_PATTERN

B = 10000


def tok(text: str) -> str:
    """wordpunct tokens of a text expression."""
    return f"regexp_extract_all(lower({text}), '{WORDPUNCT_PATTERN}')"


def bucket(g: str, num_buckets: int = B) -> str:
    """sha-256 bucket: Horner fold of the eight 32-bit words mod B."""
    c = pow(2, 32, num_buckets)
    return (f"list_reduce([0::BIGINT] || [('0x' || substr(sha256({g}), i * 8 + 1, 8))::BIGINT "
            f"for i in range(0, 8)], lambda a, x: (a * {c} + x) % {num_buckets})::INT")


def grams(w: str, n: int = 2) -> str:
    """Unigrams then i-grams (i = 2..n) of a token list, joined by one space."""
    out = w
    for i in range(2, n + 1):
        parts = " || ' ' || ".join(f"{w}[j + {k}]" for k in range(i))
        out += f" || list_transform(range(1, len({w}) - {i - 2}), lambda j: {parts})"
    return out


def uniform(seed: int, salt: str, id_expr: str) -> str:
    """Seeded uniform in (0,1), same digits as the Spark expression."""
    return (f"((('0x' || substr(sha256('{seed}:{salt}:' || CAST({id_expr} AS VARCHAR)), 1, 13))::BIGINT)::DOUBLE"
            f" + 0.5) / 4503599627370496.0")


def order_key(seed: int, salt: str, id_expr: str) -> str:
    return f"('0x' || substr(sha256('{seed}:{salt}:' || CAST({id_expr} AS VARCHAR)), 1, 13))::BIGINT"


def gumbel_e10(seed: int, salt: str, id_expr: str) -> str:
    return f"round(-ln(-ln({uniform(seed, salt, id_expr)})) * 1e10)::BIGINT"


def features_cte(source: str = "documents", id_col: str = "doc_id", text_col: str = "text", n: int = 2,
                 num_buckets: int = B, where: str = "") -> str:
    """CTEs w(doc_id, w), g(doc_id, g), dd(g, bucket), f(doc_id, bucket, cnt)."""
    wh = f"where {where}" if where else ""
    return f"""w as (select {id_col}::BIGINT doc_id, {tok(text_col)} w from {source} {wh}),
g as (select doc_id, unnest({grams('w', n)}) g from w),
dd as (select g, {bucket('g', num_buckets)} bucket from (select distinct g from g)),
f as (select doc_id, bucket, count(*)::BIGINT cnt from g join dd using (g) group by all)"""


def length_expr(L: str, n: int) -> str:
    terms = " + ".join(f"greatest({L} - {i - 1}, 0)" for i in range(1, n + 1))
    return f"floor(({terms} + {n * (n - 1) // 2}) / {n})::BIGINT"


def dense(counts: str, col: str, num_buckets: int = B, smoothing: float = 0.0) -> str:
    """All buckets with counts from `counts(bucket, cnt)` and probabilities."""
    return f"""(select i::INT bucket, coalesce(c.cnt, 0)::BIGINT {col}_cnt,
  (coalesce(c.cnt, 0) + {smoothing}) / ((select coalesce(sum(cnt), 0) from {counts}) + {smoothing * num_buckets}) {col}_p
  from range(0, {num_buckets}) x(i) left join {counts} c on x.i = c.bucket)"""


def start_number(index: str, seed: int = 0) -> str:
    """One of ``vector_classifier.start_numbers``."""
    low = "4294967295::UBIGINT"
    x = f"((({index})::UBIGINT * 2654435761::UBIGINT + {seed * 97}::UBIGINT) & {low})"
    x = f"((xor({x}, {x} >> 15) * 2246822519::UBIGINT) & {low})"
    return f"((xor({x}, {x} >> 13)::DOUBLE + 0.5) / 2147483648.0 - 1.0)"

"""Packing consecutive chosen rows (W3) and fixed-size grouping.

Position comes from the distributed dense index; each group holds at most n
rows, so grouping never concentrates data.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .select import dense_index


def pack_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "contents",
               domain_col: str = "domain", order_cols: Sequence[str] | None = None) -> DataFrame:
    """Join consecutive rows two by two.

    Text is appended with no separator, domains become a 2-element list, the
    first row's id is kept; an odd last row is dropped. Unpacked output is the
    same shape with a 1-element domain list (see :func:`as_unpacked`).
    """
    order = list(order_cols or [id_col])
    keys = dense_index(df.select(*dict.fromkeys([*order, id_col])), order, "_idx")  # positions move without the texts
    idx = df.join(keys, list(dict.fromkeys([*order, id_col])))
    s = F.struct(F.col("_idx"), F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(domain_col).alias("d"))
    g = idx.groupBy(F.floor(F.col("_idx") / 2).alias("_pair")).agg(
        F.min_by(s, F.col("_idx")).alias("a"), F.max_by(s, F.col("_idx")).alias("b"),
        F.count(F.lit(1)).alias("_n"))
    g = g.where(F.col("_n") == 2)
    return g.select(F.col("a.id").alias(id_col), F.concat(F.col("a.t"), F.col("b.t")).alias(text_col),
                    F.array(F.col("a.d"), F.col("b.d")).alias(domain_col))


def as_unpacked(df: DataFrame, domain_col: str = "domain") -> DataFrame:
    """Unpacked rows in the packed schema: the domain becomes a 1-element list."""
    return df.withColumn(domain_col, F.array(F.col(domain_col)))


def group_of_n(df: DataFrame, n: int, value_col: str, order_cols: Sequence[str],
               incomplete: str = "fill", fill_value=None) -> DataFrame:
    """Non-overlapping groups of n consecutive values.

    ``incomplete``: ``fill`` pads the last group with ``fill_value``,
    ``ignore`` drops it, ``strict`` raises if the row count is not a multiple of n.
    """
    if incomplete not in ("fill", "ignore", "strict"):
        raise ValueError(f"incomplete={incomplete!r}: a last group can be filled, ignored or refused (fill, ignore, strict)")
    idx = dense_index(df, list(order_cols), "_idx")
    g = idx.groupBy(F.floor(F.col("_idx") / n).alias("group_no")).agg(
        F.array_sort(F.collect_list(F.struct("_idx", F.col(value_col).alias("v")))).alias("_s"))
    g = g.select("group_no", F.transform("_s", lambda x: x["v"]).alias("items"))
    if incomplete == "ignore":
        return g.where(F.size("items") == n)
    if incomplete == "strict":
        short = g.where(F.size("items") != n).limit(1).count()
        if short:
            raise ValueError("row count is not a multiple of n")
        return g
    pad = F.array_repeat(F.lit(fill_value), F.lit(n) - F.size("items"))
    return g.select("group_no", F.concat("items", pad.cast(g.schema["items"].dataType)).alias("items"))

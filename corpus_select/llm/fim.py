"""Fill-in-the-middle transformation: units by one repeated capture, two cuts by a hash of the id.

One ``fullmatch`` of ``(unit)*`` per text keeps every repetition of the group, so
``match.ends(1)`` holds the end of each unit: its length is the number of units n, and
the two cuts are looked up in it. Nothing walks over the units.

The cuts and the form come from the first four 32-bit groups h1 to h4 of
sha256("seed:id"): the prefix has the smaller of h1 % (n + 1) and h2 % (n + 1) units, the
middle ends after the larger. ``rate`` percent of the texts (by h3) are transformed,
``spm_rate`` percent of those (by h4) with the suffix first. Each row is its own work:
nothing is shuffled, a lost task is run again with the same result.

Defined results: null text is empty; an empty text, and one that contains a mark, stays
plain; a null id counts as an empty one; rows with the same id get the same draw; an empty
table gives an empty one; other columns are not read and may have any names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, record_batch, slices

LINE = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")
PART_BYTES = 4 << 20  # text that is turned to Python strings at once


def draws(doc_id, seed: int) -> tuple[int, int, int, int]:
    """h1 to h4 of an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))


def cut(text: str, h: tuple[int, int, int, int], units: regex.Pattern, marks: tuple[str, str, str] = MARKS, rate: int = 100,
        spm_rate: int = 50) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix length, middle length, output) of one text; lengths in code points."""
    match = units.fullmatch(text)
    if match is None:
        raise ValueError("the units do not cover the text")
    ends = match.ends(1)
    n = len(ends)
    if not text or h[2] % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    p, s, m = marks
    if h[3] % 100 < spm_rate:
        return n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
    return n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"


def _cut_texts(unit: str, seed: int, marks, rate: int, spm_rate: int):
    def run(batches):
        units = regex.compile(f"({unit})*")
        for b in slices(batches, limit=PART_BYTES):
            ids = b.column("doc_id")
            rows = [cut(t, draws(i, seed), units, marks, rate, spm_rate) for i, t in zip(ids.to_pylist(), b.column("text").to_pylist())]
            n, form, prefix, middle, output = zip(*rows)
            yield record_batch({"doc_id": ids, "n": pa.array(n, pa.int64()), "form": pa.array(form), "prefix_chars": pa.array(prefix, pa.int64()),
                                "middle_chars": pa.array(middle, pa.int64()), "output": pa.array(output, pa.string())})
    return run


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINE, seed: int = 7, rate: int = 100,
                   spm_rate: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) per row of ``df``.

    ``unit`` is a pattern of the regex library without groups of its own; its repetitions must
    cover every text. ``marks`` stand before the prefix, the suffix and the middle.
    """
    if len(set(marks)) != 3 or not all(marks) or any(m.startswith(o[k:]) for m in marks for o in marks for k in range(1, len(o))):
        raise ValueError("marks must differ, and no mark may begin with the end of one")
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs, _cut_texts(unit, seed, tuple(marks), rate, spm_rate),
                     f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The original text, from an output and its form alone."""
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        head = F.substring_index(output.substr(F.lit(len(first) + 1), F.length(output)), second, 1)
        rest = output.substr(F.length(head) + len(first) + len(second) + 1, F.length(output))
        tail = F.substring_index(rest, m, 1)
        return head, tail, rest.substr(F.length(tail) + len(m) + 1, F.length(output))

    prefix, suffix, middle = parts(p, s)
    late, early, between = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(early, between, late)).otherwise(output)

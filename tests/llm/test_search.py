"""Multi-index search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_select.llm import multi_index
from corpus_select.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def brute(ids, x, asked, top=10):
    out = {}
    for k in np.flatnonzero([bool(asked(i)) for i in ids]):
        d = np.sqrt(((x - x[k]) ** 2).sum(1))
        out[int(ids[k])] = [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if ids[j] != ids[k]][:top]
    return out


def grouped(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def test_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got, want = grouped(QUERIES["op10_inverted_multi_index"](spark, SF)), brute(ids, x, lambda i: i % 100 == 0)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9
    at = dict(zip(ids.tolist(), x))
    for q, found in got.items():
        assert [s for _, s in found] == pytest.approx([np.sqrt(((at[q] - at[i]) ** 2).sum()) for i, _ in found], abs=1e-12)
        assert found == sorted(found, key=lambda f: (f[1], f[0]))


def test_cases(spark):
    common = [0.5, 0.25, 0.125, 1.0]
    good = [(i, common if i % 3 == 0 else [float(i % 7), 1.0, 2.0, i / 64]) for i in range(400)]
    bad = [(1000, None), (1100, [0.0] * 4), (1200, [1.0, None, 1.0, 1.0]), (1300, [float("nan")] * 4), (1400, [float("inf"), 1.0, 1.0, 1.0]), (1500, [1.0, 1.0]), (1600, []), (None, common), (100, good[100][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in good + bad], "vec_id long, embedding array<float>, v string, cell int").repartition(5)
    want = brute(np.array([i for i, _ in good]), np.array([v for _, v in good]), lambda i: i % 100 == 0)
    got = grouped(multi_index.search(df, F.col("vec_id") % 100 == 0))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    few = df.where("vec_id < 3")
    assert {q: len(v) for q, v in grouped(multi_index.search(few, F.col("vec_id") % 100 == 0)).items()} == {0: 2}
    assert multi_index.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8))
    books, share = multi_index.fit(x, 8)
    sizes = np.bincount(books.cells(x), minlength=64)
    order = books.walk(x[0], sizes, 500)
    far = [((books.left[c // 8] - x[0][:4]) ** 2).sum() + ((books.right[c % 8] - x[0][4:]) ** 2).sum() for c in order]
    assert far == sorted(far) and sizes[order].sum() == 500 and 0 < share <= 1


def test_large_cells_are_dealt_to_several_shards():
    first, many = multi_index._shards(np.array([10, 3 * multi_index.SHARD + 1, 5, multi_index.SHARD - 2, 4]))
    assert many.tolist() == [1, 4, 1, 1, 1] and first[2] >= first[1] + many[1] and len(set(first.tolist())) >= 4

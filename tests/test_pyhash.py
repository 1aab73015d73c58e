"""Python's own string hash against child interpreters."""

import json
import os
import subprocess
import sys

import pytest

from corpus_select.functions.pyhash import key_of_seed, python_buckets, python_hashes
from corpus_select.operators.features import ngram_features
from conftest import SF01

ODD = ["", "a", "abcdefg", "abcdefgh", "abcdefghi", "ÿ" * 7, "é", "Ā", "中文" * 9, "𝄞", "a𝄞" * 5, "\0", "\0" * 8, "x" * 1000, "ÿĀ", "w " * 300]


def child(strings, seed, buckets):
    code = "import json, sys; s, b = json.load(sys.stdin); json.dump([[hash(x) for x in s], [abs(hash(x)) % b for x in s]], sys.stdout)"
    done = subprocess.run([sys.executable, "-c", code], input=json.dumps([strings, buckets]), capture_output=True, text=True, check=True, env={**os.environ, "PYTHONHASHSEED": str(seed)})
    return json.loads(done.stdout)


@pytest.mark.parametrize("seed", [0, 1, 42, 4294967295])
def test_odd_strings(seed):
    want, buckets = child(ODD, seed, 10_000)
    assert python_hashes(ODD, seed).tolist() == want
    assert python_buckets(ODD, 10_000, seed).tolist() == buckets


def test_all_ngrams_of_benchmark(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()]
    import re
    grams = set()
    for t in texts:
        w = re.findall(r"\w+|[^\w\s]+", t.lower())
        grams |= {*w, *(" ".join(p) for p in zip(w, w[1:]))}
    grams = sorted(grams)
    assert python_buckets(grams, 10_000, 7).tolist() == child(grams, 7, 10_000)[1]


def test_features_under_the_python_hash(spark):
    df = spark.createDataFrame([(1, "Ba ba é, 中"), (2, "")], "doc_id long, text string")
    row = {r.doc_id: dict(zip(r.buckets, r.counts)) for r in ngram_features(df, n=2, num_buckets=1 << 20, hash_fn="python:42").collect()}
    grams = ["ba", "ba", "é", ",", "中", "ba ba", "ba é", "é ,", ", 中"]
    want = {}
    for b in child(grams, 42, 1 << 20)[1]:
        want[b] = want.get(b, 0) + 1
    assert row == {1: want, 2: {}}


def test_seeds():
    assert key_of_seed(0) == (0, 0) and key_of_seed(1) != key_of_seed(2)
    with pytest.raises(ValueError):
        key_of_seed(1 << 32)
    with pytest.raises(ValueError):
        ngram_features(None, hash_fn="md5")

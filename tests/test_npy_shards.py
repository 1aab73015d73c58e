"""The .npy source and sink and the per-shard sink, with their commits."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpus_select.sources import npy, shards, staged
from conftest import SF01


def arrays(folder, sizes, dim=3, dtype="<f4"):
    os.makedirs(folder, exist_ok=True)
    rng = np.random.default_rng(1)
    out = [rng.normal(size=(n, dim)).astype(dtype) for n in sizes]
    for i, a in enumerate(out):
        np.save(f"{folder}/{chr(97 + i)}.npy", a)
    return np.concatenate(out) if out else np.zeros((0, dim))


def rows_of(df):
    return {r.row: r.embedding for r in df.collect()}


@pytest.mark.parametrize("rows", [1, 4, 1000])
@pytest.mark.parametrize("dtype", ["<f4", "<f8", "<f2", ">f4"])
def test_files_are_split_and_rows_numbered(spark, tmp_out, rows, dtype, monkeypatch):
    want = arrays(f"{tmp_out}/x", [5, 0, 9, 1], dtype=dtype)
    df = npy.read_npy(spark, f"{tmp_out}/x", rows)
    assert df.rdd.getNumPartitions() == {1: 15, 4: 6, 1000: 3}[rows]
    found = rows_of(df)
    assert sorted(found) == list(range(15)) and all(np.allclose(found[i], want[i].astype(np.float32)) for i in found)
    one = rows_of(npy.read_npy(spark, f"file://{tmp_out}/x/c.npy", rows))
    assert len(one) == 9 and np.allclose(one[0], want[5].astype(np.float32))


def test_batches_of_few_rows(tmp_out, monkeypatch):
    monkeypatch.setattr(npy, "BATCH_BYTES", 30)
    want = arrays(f"{tmp_out}/x", [11])
    reader = npy.NpyReader(f"{tmp_out}/x", 7)
    parts = reader.partitions()
    got = [b for p in parts for b in reader.read(p)]
    assert [b.num_rows for b in got] == [2, 2, 2, 1, 2, 2] and np.allclose([v for b in got for v in b.column(1).to_pylist()], want)


def test_odd_folders(spark, tmp_out):
    os.makedirs(f"{tmp_out}/none")
    assert npy.read_npy(spark, f"{tmp_out}/none").count() == 0
    reader = npy.NpyReader(f"{tmp_out}/missing", 5)
    with pytest.raises(FileNotFoundError):
        reader.partitions()
    for name, a in {"flat": np.zeros(3), "columns": np.asfortranarray(np.zeros((3, 2))), "ints": np.zeros((2, 2), int)}.items():
        os.makedirs(f"{tmp_out}/{name}")
        np.save(f"{tmp_out}/{name}/a.npy", a)
        with pytest.raises(ValueError):
            npy.NpyReader(f"{tmp_out}/{name}", 5).partitions()
    arrays(f"{tmp_out}/mixed", [2], dim=3)
    np.save(f"{tmp_out}/mixed/z.npy", np.zeros((2, 4), "f4"))
    with pytest.raises(ValueError):
        npy.NpyReader(f"{tmp_out}/mixed", 5).partitions()
    arrays(f"{tmp_out}/cut", [50])
    with open(f"{tmp_out}/cut/a.npy", "r+b") as f:
        f.truncate(300)
    with pytest.raises(PySparkException):
        npy.read_npy(spark, f"{tmp_out}/cut").count()


def test_round_trip_of_embeddings(spark, tmp_out):
    emb = spark.read.parquet(f"{SF01}/embeddings.parquet")
    npy.write_npy(emb.repartition(5), f"{tmp_out}/e", "vec_id", files=4)
    assert len(npy.npy_files(f"{tmp_out}/e")) == 4 and sorted(os.listdir(f"{tmp_out}/e")) == npy.npy_files(f"{tmp_out}/e")
    want = [r.embedding for r in emb.orderBy("vec_id").collect()]
    found = rows_of(npy.read_npy(spark, f"{tmp_out}/e", 37))
    assert [found[i] for i in range(len(want))] == want
    assert sum(len(np.load(f"{tmp_out}/e/{f}")) for f in npy.npy_files(f"{tmp_out}/e")) == len(want)
    with pytest.raises(PySparkException):  # files are there already
        npy.write_npy(emb, f"{tmp_out}/e", "vec_id", files=4)
    npy.write_npy(emb.limit(10), f"{tmp_out}/e", "vec_id", files=1, mode="overwrite")
    assert npy.read_npy(spark, f"{tmp_out}/e").count() == 10 and len(os.listdir(f"{tmp_out}/e")) == 1


LINES = ['{"b": 1,  "a": "\\u00e9\\/é"}', '{"a":1,"b":2}', "", '  {"x":"𝄞"}\t', '{"dup":1,"dup":2}']


def test_lines_stay_byte_for_byte(spark, tmp_out):
    rows = [(i, LINES[i % 5]) for i in range(60)] + [(61, None), (None, "lost")]
    df = spark.createDataFrame(rows, "doc_id long, value string").repartition(7)
    shards.write_shards(df, f"{tmp_out}/s", F.col("doc_id") % 4, ["doc_id"], 3)
    assert sorted(os.listdir(f"{tmp_out}/s")) == [f"selected_samples_{i}.jsonl" for i in range(4)]
    for k in range(4):
        with open(f"{tmp_out}/s/selected_samples_{k}.jsonl", "rb") as f:
            assert f.read() == b"".join(LINES[i % 5].encode() + b"\n" for i in range(60) if i % 4 == k)
    back = shards.read_shards(spark, f"{tmp_out}/s")
    assert back.count() == 60 and back.where("shard = 3 and value = ''").count() == sum(i % 4 == 3 and i % 5 == 2 for i in range(60))


def test_a_failed_task_leaves_nothing(spark, tmp_out):
    bad = spark.range(200, numPartitions=4).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 150, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("value"))
    with pytest.raises(PySparkException):
        shards.write_shards(bad, f"{tmp_out}/f", F.col("doc_id") % 2, ["doc_id"], 2)
    assert not os.path.exists(f"{tmp_out}/f") or os.listdir(f"{tmp_out}/f") == []


def shard_bytes(folder):
    return {f: open(f"{folder}/{f}", "rb").read() for f in os.listdir(folder)}


@pytest.fixture()
def placed(monkeypatch):
    """What ``write_shards`` puts together, call by call."""
    calls, real = [], shards._placed
    monkeypatch.setattr(shards, "_placed", lambda *a: calls.append(real(*a)) or calls[-1])
    return calls


def test_a_large_shard_is_written_in_pieces_even_in_bytes(spark, tmp_out, placed):
    # nearly all bytes in the last tenth of one shard's keys
    rows = [(i, 1 if i % 50 == 0 else 2, "é" * (600 if i > 3600 else 3) + str(i)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, shard int, value string").repartition(5)
    shards.write_shards(df, f"{tmp_out}/s", F.col("shard"), ["doc_id"], 4, piece_bytes=20_000)
    want = {f"selected_samples_{k}.jsonl": b"".join(v.encode() + b"\n" for _, s, v in rows if s == k) for k in (1, 2)}
    assert shard_bytes(f"{tmp_out}/s") == want
    sizes = [size for _, _, size, _ in placed[0]]
    assert sum(sizes) == sum(map(len, want.values())) and len(sizes) > 15 and max(sizes) < 60_000


def test_repeated_and_null_keys_do_not_hold_a_shard_together(spark, tmp_out, placed):
    rows = [(None if i % 2 else 7, f"line {i} " + "x" * 90) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, value string").repartition(3)
    shards.write_shards(df, f"{tmp_out}/s", F.lit(0), ["doc_id"], 1, piece_bytes=10_000)
    found = shard_bytes(f"{tmp_out}/s")["selected_samples_0.jsonl"].decode().splitlines()
    assert set(found[:1000]) == {v for d, v in rows if d is None} and set(found[1000:]) == {v for d, v in rows if d == 7}
    assert len(found) == 2000 and max(size for _, _, size, _ in placed[0]) < 40_000


def test_shards_beyond_the_number_given_are_cut_too(spark, tmp_out, placed):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("y"), 99).alias("value"))
    shards.write_shards(df, f"{tmp_out}/s", F.col("doc_id") % 30, ["doc_id"], 1, piece_bytes=1000)
    assert {f: len(b) for f, b in shard_bytes(f"{tmp_out}/s").items()} == {f"selected_samples_{k}.jsonl": 1000 for k in range(30)}


def test_existing_shards_stay_on_append_and_go_on_overwrite(spark, tmp_out):
    df = spark.range(8).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("value"))
    shards.write_shards(df, f"{tmp_out}/s", F.col("doc_id") % 2, ["doc_id"], 2)
    first = shard_bytes(f"{tmp_out}/s")
    with pytest.raises(PySparkException):
        shards.write_shards(df.limit(3), f"{tmp_out}/s", F.col("doc_id") % 2, ["doc_id"], 2)
    assert shard_bytes(f"{tmp_out}/s") == first
    shards.write_shards(df.where("doc_id < 3"), f"{tmp_out}/s", F.lit(1), ["doc_id"], 2, mode="overwrite")
    assert shard_bytes(f"{tmp_out}/s") == {"selected_samples_1.jsonl": b"0\n1\n2\n"}
    shards.write_shards(df.where("doc_id < 0"), f"{tmp_out}/s", F.lit(1), ["doc_id"], 2, mode="overwrite")
    assert shard_bytes(f"{tmp_out}/s") == {}


@pytest.mark.parametrize("ranges", [True, False])
def test_pieces_are_joined_by_ranges_or_by_one_stream(tmp_out, ranges, monkeypatch):
    monkeypatch.setattr(shards, "writes_ranges", lambda fs: ranges)
    os.makedirs(f"{tmp_out}/p")
    for name, data in {"0_9": b"b\n", "0_10": b"c\n", "0_2": b"a\n", "3_1": b"d\n"}.items():
        with open(f"{tmp_out}/p/{name}", "wb") as f:
            f.write(data)
    rows = shards._placed(tmp_out, "p")
    assert len(rows) == (4 if ranges else 2)
    writer = shards.ShardWriter(tmp_out, False)
    batches = [pa.RecordBatch.from_pylist([dict(zip(("shard", "start", "size", "files"), r))]) for r in reversed(rows)]
    # a second attempt of the first row writes the same bytes
    if ranges:
        writer.write(iter(batches[:1]))
    writer.commit([writer.write(iter([b])) for b in batches])
    assert sorted(os.listdir(tmp_out)) == ["p", "selected_samples_0.jsonl", "selected_samples_3.jsonl"]
    assert [open(f"{tmp_out}/selected_samples_{k}.jsonl", "rb").read() for k in (0, 3)] == [b"a\nb\nc\n", b"d\n"]


class Half(staged.StagedWriter):
    def owns(self, name):
        return True

    def files(self, batches):
        yield "a", iter([b"1"])

        def broken():
            yield b"2"
            raise RuntimeError("lost")
        yield "b", broken()


def test_a_failed_attempt_removes_its_files(tmp_out):
    writer = Half(f"{tmp_out}/h", False)
    with pytest.raises(RuntimeError):
        writer.write(iter([]))
    assert os.listdir(f"{tmp_out}/h/{writer.stage}") == []
    writer.abort([])
    assert os.listdir(f"{tmp_out}/h") == []
    with pytest.raises(ValueError):
        writer.commit([staged.Staged([("x", "y")]), staged.Staged([("z", "y")])])


def test_named_files(spark, tmp_out):
    rows = [("a/x.txt", "one"), ("a/y.txt", ""), ("b.txt", "zwei é")]
    staged.write_files(spark.createDataFrame(rows, "name string, content string").repartition(3), f"{tmp_out}/n")
    found = {os.path.relpath(os.path.join(d, f), f"{tmp_out}/n"): open(os.path.join(d, f), encoding="utf-8").read() for d, _, fs in os.walk(f"{tmp_out}/n") for f in fs}
    assert found == dict(rows)
    for bad in ("../out.txt", "/abs.txt", "a//b"):
        with pytest.raises(PySparkException):
            staged.write_files(spark.createDataFrame([(bad, "x")], "name string, content string"), f"{tmp_out}/n")
    assert sorted(os.listdir(tmp_out)) == ["n"] and sorted(os.listdir(f"{tmp_out}/n")) == ["a", "b.txt"]

"""Packing, BPE round trips and prefix counts against the tokenizer libraries."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpus_select.llm import bpe, packing, token_counts
from corpus_select.llm.queries import QUERIES, tokenizer_file

SF = "/root/testdata/sf0.001"
TEXTS = ["Hello  World!! it's  don't 'S \x1c!a!\x1cb", "<|endoftext|>Hi<|startoftext|>x<|endoftext|> ok", "É́é  ÀÇ ß ẞ ſ İstanbul ΑΣ ſt ½²3", " a b c\x85d", "", None, "\n\n a\n  b \n", "   ", "\xa0",
         "日本語 テキスト 😀👍🏽 don't", "a" * 3000, "x\ty\r\nz\x0bq\x0c", "it's'll've'd!!'s ''' 's's", "▁▁ a ▁b", "ends ", "\nstart", "same", "same", "word " * 5000]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, -1, "x") for i, t in enumerate(TEXTS)] + [(3, "other text, same id", 0, "y"), (None, "no id", 0, "z")]
    # extra columns carry names that the operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, block string").repartition(3)


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def test_bpe_round_trip(texts, word_bpe):
    got = sorted((r.doc_id is None, r.doc_id, bytes(r.ids), r.decoded, r.n_tokens) for r in bpe.encode_decode(texts, tokenizer_file("word_bpe_49k.json")).collect())
    want = []
    for r in texts.collect():
        ids = ids_of(word_bpe, r.text)
        want.append((r.doc_id is None, r.doc_id, np.array(ids, "<u4").tobytes(), word_bpe.decode(ids, skip_special_tokens=False), len(ids)))
    assert got == sorted(want)
    assert bpe.encode_decode(texts.limit(0), tokenizer_file("word_bpe_49k.json")).count() == 0


def test_bpe_query(spark, word_bpe):
    rows = {r.doc_id: r for r in QUERIES["op3_bpe_encoding"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = ids_of(word_bpe, d.text)
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(word_bpe.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def check_packing(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(texts, word_bpe):
    rows = packing.pack(packing.cut_texts(texts, tokenizer_file("word_bpe_49k.json"), 2048), 2048).collect()
    used = check_packing(rows, 2048)
    want, total = [], 0
    for r in texts.collect():
        ids = [*ids_of(word_bpe, r.text), 0]
        total += len(ids)
        want += [(r.doc_id is None, r.doc_id, k, k * 2048, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k in range(-(-len(ids) // 2048)) for p in [ids[k * 2048:(k + 1) * 2048]]]
    assert sorted((r.doc_id is None, r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert used <= -(-total // 2048) + 1
    kept = packing.cut_texts(texts, tokenizer_file("word_bpe_49k.json"), 64, keep_ids=True).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 256 for r in kept)
    assert packing.pack(packing.cut_texts(texts.limit(0), tokenizer_file("word_bpe_49k.json"))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=300))
def test_plan_places_every_piece(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    rooms = {}
    numbers = {n: set() for n in counts}
    for n, first, count, at, per, offset in packing.plan(counts, 100):
        for j in range(count):
            numbers[n].add(first + j)
            rooms.setdefault(at + j // per, []).append((offset + j % per * n, n))
    assert all(numbers[n] == set(range(c)) for n, c in counts.items())
    big = 0
    for parts in rooms.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 100
        big = max(big, sum(3 * n > 100 for _, n in parts))
    assert big <= 2
    # never worse than first-fit's bound: no two sequences are both at most half full
    assert sum(sum(n for _, n in p) <= 50 for p in rooms.values()) <= 1


def test_plan_is_small_for_many_pieces():
    rng = np.random.default_rng(1)
    counts = {int(n): int(c) for n, c in zip(range(1, 2049), rng.integers(0, 10**7, 2048))}
    segments = packing.plan(counts, 2048)
    total = sum(n * c for n, c in counts.items())
    assert len(segments) < 200_000
    assert max(at + (count - 1) // per for _, _, count, at, per, _ in segments) + 1 <= 1.01 * total / 2048 + sum(c for n, c in counts.items() if 3 * n > 2048) * 0.2


def test_counts_and_prefixes(texts, pieces):
    path = tokenizer_file("piece_bpe_32k.model")
    counts = token_counts.prefix_counts(texts, path)
    rows = counts.collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_bytes) for r in rows) == sorted((r.doc_id or -1, len(pieces.encode(r.text or "")), len((r.text or "").encode())) for r in texts.collect())
    by = {r.text or "": r for r in texts.collect()}
    known = {r.doc_id: r for r in rows if r.doc_id not in (3, None)}
    for text, row in by.items():
        if row.doc_id in known and len(text) <= 80:
            steps = np.cumsum(np.frombuffer(bytes(known[row.doc_id].steps), np.int8), dtype=int)
            assert [int(c) for c in steps[1:]] == [len(pieces.encode(text[:p])) for p in range(1, len(text) + 1)]
    fits = {r.doc_id: r for r in token_counts.fit_budget(counts.where("doc_id not in (3)"), 5).collect()}
    for text, row in by.items():
        if row.doc_id in fits and row.doc_id is not None and len(text) <= 80:
            best = max((p for p in range(len(text) + 1) if len(pieces.encode(text[:p])) <= 5), default=0)
            assert fits[row.doc_id].fit_chars == best
    assert token_counts.prefix_counts(texts.limit(0), path).count() == 0


def test_count_query(spark, pieces):
    rows = {r.doc_id: r for r in QUERIES["op8_token_counts"](spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n, r = len(pieces.encode(d.text)), rows[d.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(d.text.encode()), n, n > 4096)
        if n <= 4096:
            assert (r.fit_chars, r.fit_tokens) == (len(d.text), n)
        else:  # the longest prefix within the limit: one character more is beyond it
            assert r.fit_tokens == len(pieces.encode(d.text[:r.fit_chars])) <= 4096 < len(pieces.encode(d.text[:r.fit_chars + 1]))



@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab theTHE'.,\n  ▁é日<|>12"), max_size=60))
def test_library_counts_of_any_text(text):
    import pyarrow as pa
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    counts, codes, words = token_counts.units(pa.array([text], pa.large_string()))
    steps = token_counts.counter(path).words(words)
    total = sum(int(np.frombuffer(steps[c], np.int8).sum()) for c in codes)
    assert total == len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))

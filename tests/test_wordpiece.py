"""Subword ids against a public tokenizer library and a slow reference."""

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from corpus_select.operators import mlm, wordpiece
from corpus_select.plans.catalog_model import public_vocabulary
from conftest import SF001

PIECES = ["un", "##aff", "##able", "aff", "a", "##a", "b", "##b", "run", "##ning", "!", ",", "é", "中", "hello", "##lo", "hel", "##l", "##", "x#", "café", "cafe"]
ODD = ["unaffable running!", "", None, "   ", "Hello, HELLO  hel\thello\nhelol", "a" * 100 + " " + "a" * 101, "zzz a", "café CAFÉ café", "中文a中", "a​b a\x00b a\x0bb", "x## ## #",
       "a b a　b", "ﬁ İ ß ẞ", "a!b!!a", "¿a? «b» ₤a b€", "�a"]


def library(tokens):
    t = Tokenizer(models.WordPiece({p: i for i, p in enumerate(tokens)}, unk_token="[UNK]", max_input_chars_per_word=100, continuing_subword_prefix="##"))
    t.normalizer = normalizers.BertNormalizer(lowercase=True, strip_accents=True, clean_text=True, handle_chinese_chars=True)
    t.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    return t


def slow(word, ids):
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in ids and not (at == 0 and piece.startswith("##") and len(piece) > 2):
                out.append(ids[piece])
                break
        else:
            return [mlm.UNK]
        at = end
    return out if len(word) <= 100 else [mlm.UNK]


def ids_of(df):
    return {r.doc_id: r.ids0 for r in df.collect()}


def test_odd_texts_as_the_library_has_them(spark):
    vocab = wordpiece.vocab_table(spark, PIECES)
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").repartition(4)
    known = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", *PIECES]
    lib = library(known)
    found = ids_of(wordpiece.wordpiece_ids(df, vocab))
    for k, text in enumerate(ODD):
        assert found[k] == lib.encode(text or "", add_special_tokens=False).ids, text


def test_documents_as_the_library_has_them(spark):
    pieces = wordpiece.pieces_of_bpe(public_vocabulary())
    assert len(pieces) == len(set(pieces)) and all(p.isascii() for p in pieces)
    lib = library(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", *pieces])
    df = spark.read.parquet(f"{SF001}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    found = ids_of(wordpiece.wordpiece_ids(df.repartition(5), wordpiece.vocab_table(spark, pieces)))
    assert found == {k: lib.encode(t or "", add_special_tokens=False).ids for k, t in texts.items()}


def test_trie_against_a_slow_search():
    rng = np.random.default_rng(4)
    tokens = sorted({("##" if rng.random() < 0.6 else "") + "".join(rng.choice(list("abc"), rng.integers(1, 5))) for _ in range(60)})
    ids = {t: i + mlm.N_SPECIAL for i, t in enumerate(tokens)}
    trie = wordpiece.Trie(tokens, list(ids.values()))
    for _ in range(3000):
        word = "".join(rng.choice(list("abcd"), rng.integers(0, 12), p=[0.4, 0.3, 0.28, 0.02]))
        assert trie.pieces(word) == slow(word, ids)


def test_padding_pairs_and_limits(spark, monkeypatch):
    vocab = wordpiece.vocab_table(spark, PIECES)
    df = spark.createDataFrame([(1, "unaffable hello", "a b a b"), (2, "  ", "a"), (3, "a", None)], "doc_id int, text string, second string")
    one = {r.doc_id: r for r in wordpiece.wordpiece_encode(df, vocab, max_length=5).collect()}
    assert sorted(one) == [1, 3]
    assert one[1].input_ids == [mlm.CLS, 5, 6, 7, mlm.SEP] and one[3].input_ids == [mlm.CLS, 9, mlm.SEP, 0, 0] and one[3].special_tokens_mask == [1, 0, 1, 1, 1]
    two = {r.doc_id: r for r in wordpiece.wordpiece_encode(df, vocab, max_length=8, pair_col="second").collect()}
    assert two[1].input_ids == [2, 5, 6, 7, 3, 9, 11, 3] and two[1].token_type_ids == [0, 0, 0, 0, 0, 1, 1, 1]
    assert two[3].input_ids == [2, 9, 3, 3, 0, 0, 0, 0]
    monkeypatch.setattr(wordpiece, "SMALL_VOCAB", 3)
    with pytest.raises(ValueError):
        wordpiece.wordpiece_ids(df, vocab)


def test_batches_are_cut_by_bytes_and_words_forgotten(spark, monkeypatch):
    vocab = wordpiece.vocab_table(spark, PIECES)
    texts = [f"{'a' * (k % 7)} run{'ning' * (k % 3)} b!" for k in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = ids_of(wordpiece.wordpiece_ids(df, vocab))
    monkeypatch.setattr(wordpiece, "SLICE_BYTES", 64)
    monkeypatch.setattr(wordpiece, "KNOWN_WORDS", 2)
    fn = wordpiece._encoder(type("B", (), {"value": (PIECES, list(range(5, 5 + len(PIECES))))})(), 1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], names=["doc_id", "text"])
    parts = list(fn([batch]))
    assert len(parts) > 20 and {i: x for p in parts for i, x in zip(p.column(0).to_pylist(), p.column(1).to_pylist())} == want

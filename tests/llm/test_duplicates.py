"""Near-duplicate join, line dedup, components and the pipeline against brute force."""

import functools
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from corpus_select.llm import jaccard, lines
from corpus_select.llm.components import components
from corpus_select.llm.queries import QUERIES
from corpus_select.llm.shingles import mix

SF = "/root/testdata/sf0.001"


class Groups(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def normal(text):
    return [w for w in (re.sub(r"[\W_]+", "", x.lower()) for x in re.split("[ \t\n\r\x0b\x0c]+", text)) if w]


def brute_near(rows):
    """doc -> (class, copies, links, group); rows are (doc, text) in order of docs."""
    words = {k: tuple(normal(t or "")) for k, t in rows}
    sets = {k: {w[i:i + 5] for i in range(len(w) - 4)} or {w} for k, w in words.items()}
    classes, links, groups = {}, {}, Groups()
    for k, w in words.items():
        classes.setdefault(w, []).append(k)
    heads = [v[0] for w, v in classes.items() if w]
    for a, b in itertools.combinations(heads, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
            groups.join(a, b)
    return {k: (v[0], len(v), links.get(v[0], 0), groups.find(v[0])) for v in classes.values() for k in v}


def family(seed, n, words=120, edits=2):
    """Near copies of one text: each with a few words replaced."""
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 10**6, words)]
    out = []
    for _ in range(n):
        own = list(base)
        for i in rng.integers(0, words, edits):
            own[i] = f"e{rng.integers(0, 10**9)}"
        out.append(" ".join(own))
    return out


def near_rows(df):
    return {r.doc_id: (r.class_id, r.n_copies, r.n_links, r.group_id) for r in df.collect()}


def test_near_duplicates_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert near_rows(QUERIES["op6_ngram_jaccard_join"](spark, SF)) == brute_near(sorted((r.doc_id, r.text) for r in docs.collect()))


def test_near_duplicates_of_families(spark):
    texts = [*family(1, 60), *family(2, 30, 300, 5), *family(3, 20, 12, 1), "same text here twice over again", "Same text, here twice over AGAIN!", "", None, "...", "a b", "A B.", "long " * 30000]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id int, text string, version string").repartition(6)
    assert near_rows(jaccard.near_duplicates(df)) == brute_near(rows)
    kept = jaccard.keep_one(df)
    want = {g for *_, g in brute_near(rows).values()}
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_families_dealt_in_blocks(spark, monkeypatch):
    """Large families are verified block by block; the dealing is decided on the driver."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rows = list(enumerate([*family(4, 60, 200, 2), *family(9, 5, 80, 1)]))
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    assert near_rows(jaccard.near_duplicates(df)) == brute_near(rows)


def threshold_pairs(seed, n, words=121, run=9):
    """Pairs that share 104 of 130 shingles, which is the threshold exactly."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        base = [f"w{x}" for x in rng.integers(0, 10**9, words)]
        own = base[:50] + [f"e{x}" for x in rng.integers(0, 10**9, run)] + base[50 + run:]
        out += [" ".join(base), " ".join(own)]
    return out


def test_threshold_pairs_beside_a_large_family(spark):
    """The many links of one family do not end the search for the others' links."""
    texts = threshold_pairs(20, 400)
    rows = list(enumerate([*texts, *family(21, 200, 200, 1)]))
    got = near_rows(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string").repartition(6)))
    assert {k: got[k] for k in range(len(texts))} == {k: (k, 1, 1, k - k % 2) for k in range(len(texts))}


def test_prefixes_are_shortened_as_far_as_weak_links_need(spark):
    def depth_of(texts):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        described = spark.createDataFrame(jaccard.arrow_map(jaccard.documents(docs, "doc_id", "text"), jaccard._describe, "doc_id long, version long, high long, low long, values binary").collect(),
                                          "doc_id long, version long, high long, low long, values binary")
        return jaccard.prefix_length(jaccard.trie_links(described.dropDuplicates(["high", "low"])), jaccard.SIMILARITY, jaccard.RECALL)
    close = [t for k in range(150) for t in family(1000 + k, 2, 400, 1)]  # similarity about 0.975
    weak = threshold_pairs(22, 600)
    assert depth_of(close) == jaccard.DEPTH and depth_of(close[:2] * 9) == jaccard.DEPTH and depth_of(["a b", "c d"]) == jaccard.DEPTH
    assert depth_of(weak) < jaccard.DEPTH and depth_of(weak + family(5, 400, 400, 1)) < jaccard.DEPTH


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (4, "other")], "doc_id int, text string")
    got = sorted((r.doc_id or 0, r.class_id, r.n_copies, r.group_id) for r in jaccard.near_duplicates(df).collect())
    assert got == [(0, 4, 4, 4), (0, 4, 4, 4), (4, 4, 1, 4), (4, 4, 4, 4), (4, 4, 4, 4)]
    assert sorted(r.text for r in jaccard.keep_one(df).collect()) == ["a b c d e f", "other"]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0 and jaccard.keep_one(df.limit(0)).count() == 0


def test_trie_links_over_batch_borders():
    """However the sorted rows are cut: each row is linked to the first of its deepest shared prefix."""
    rng = np.random.default_rng(0)
    rows = sorted({(int(p), int(b), int(n)) for p, b, n in zip(rng.integers(0, 40, 3000), rng.integers(0, 3, 3000) << 16 | rng.integers(0, 3, 3000), rng.integers(0, 10**9, 3000))})
    want, first = [], {}
    for p, b, n in rows:
        keys = [(p,), (p, b >> 16), (p, b >> 16, b)]
        shared = [d for d, k in enumerate(keys) if k in first]
        if shared:
            want.append((first[keys[shared[-1]]], n, jaccard.FLOOR + shared[-1]))
        for k in keys:
            first.setdefault(k, n)
    for step in (1, 7, 500, 5000):
        cut = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i:i + step]], pa.int64()) for k in (0, 2, 1)], ["prefix", "node", "back"]) for i in range(0, len(rows), step)]
        assert [(r["a"], r["b"], r["depth"]) for b in jaccard._trie_links(iter(cut)) for r in b.to_pylist()] == want


def test_products_count_shared_shingles():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 3000, 400).astype(np.uint64)) for _ in range(30)]
    assert (jaccard._shared(sets) == [[len(np.intersect1d(a, b)) if len(np.intersect1d(a, b)) else 0 for b in sets] for a in sets])[np.triu_indices(30, 1)].all()


@functools.cache
def word_code(word):
    raw = word.encode()
    h = np.array([len(raw)], np.uint64) + lines._STEP
    h = mix(h)
    for k in range(0, len(raw), 8):
        h = mix(h ^ np.array([int.from_bytes(raw[k:k + 8], "little")], np.uint64))
    return int(h[0])


def line_codes(keys):
    """normalised line -> (words, 128-bit SimHash)."""
    out, seeds = {}, [int(s) for s in lines._SEEDS]
    for line in set(keys):
        words = [word_code(w) for w in line.split()]
        own = np.array([min(7, len(w)) for w in line.split()])
        code = 0
        for k, seed in enumerate(seeds):
            h = mix(np.array([w ^ seed for w in words], np.uint64))
            for b in range(64):
                code |= int(2 * own[(h >> np.uint64(b) & np.uint64(1)) == 1].sum() > own.sum()) << (64 * k + b)
        out[line] = len(words), code
    return out


def meet(x, y):
    (m, a), (n, b) = x, y
    far = a ^ b
    radius = next(r for top, r in lines.RADIUS if max(m, n) < top)
    return min(m, n) >= lines.least_words(lines.SIMILARITY) and far.bit_count() <= radius and any(not far >> 12 * k & 0xFFF for k in range(10))


def brute_lines(rows):
    occurrences = {}
    for k, t in rows:
        for i, line in enumerate(t.split("\n")):
            n = lines.normal_line(line)
            if n:
                occurrences.setdefault(n, []).append((k, i))
    keys = list(occurrences)
    codes = line_codes(keys)
    groups = Groups()
    for i in range(len(keys)):
        for j in range(i):
            if meet(codes[keys[i]], codes[keys[j]]) and lines.edit_similarity(keys[i].split(), keys[j].split(), lines.SIMILARITY):
                groups.join(i, j)
    first = {}
    for i, k in enumerate(keys):
        g = groups.find(i)
        first[g] = min(first.get(g, occurrences[k][0]), occurrences[k][0])
    gone = {o for i, k in enumerate(keys) for o in occurrences[k] if o != first[groups.find(i)]}
    return {k: "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone) for k, t in rows}


def test_line_dedup_of_documents(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r.text for r in QUERIES["op9_line_dedup"](spark, SF).collect()}
    assert got == brute_lines(rows) and any(got[k] != t for k, t in rows)


def test_line_dedup_cases(spark):
    near = family(5, 12, 300, 1)
    rows = [(1, "Hello, World\n\n---\nunique one"), (2, "hello world\n\n---\nhello   WORLD!"), (3, "\n".join(near[:6])), (4, "\n".join(near[6:]) + "\nlast"), (5, ""), (6, "x " * 40000), (7, "X " * 40000)]
    df = spark.createDataFrame([(k, t, "m", k) for k, t in rows] + [(8, None, "n", 0)], "doc_id int, text string, lines string, gone int").repartition(3)
    out = lines.dedup_lines(df)
    got = {r.doc_id: r.text for r in out.collect()}
    want = brute_lines(rows)
    assert out.columns == df.columns and got == {**want, 8: None}
    assert got[2] == "\n---" and got[7] == "" and len(got[3].split("\n")) + len(got[4].split("\n")) < 13
    assert lines.dedup_lines(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b c\nd"), (1, "a b c\nd"), (None, "a b c"), (0, "other")], "doc_id int, text string")
    assert sorted((r.doc_id or -1, r.text) for r in lines.dedup_lines(twice).collect()) == [(-1, ""), (-1, "other"), (1, "a b c\nd"), (1, "a b c\nd")]


def test_line_dedup_of_families_in_small_groups(spark, monkeypatch):
    """Crowded block values and large candidate groups, dealt as pairs of groups."""
    rows = [(k, "\n".join(family(k, 8, 40, 2)[:6] + family(99, 30, 60, 3)[k * 3:k * 3 + 3])) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(6)
    want = brute_lines(rows)
    for crowd, task, block in ((3, 40, 4), (7, 10**6, 2048)):
        monkeypatch.setattr(lines, "CROWD", crowd)
        monkeypatch.setattr(lines, "TASK", task)
        monkeypatch.setattr(lines, "BLOCK", block)
        assert {r.doc_id: r.text for r in lines.dedup_lines(df).collect()} == want


def test_deal_of_block_values():
    counts = np.array([5, 0, 3 * lines.CROWD, lines.CROWD, 1, lines.CROWD + 1])
    first, groups = lines.deal_blocks(counts)
    assert groups.tolist() == [1, 1, 3, 1, 1, 2]
    used = [set(range(f, f + (g * (g + 1) // 2 if g > 1 else 0))) for f, g in zip(first.tolist(), groups.tolist())]
    assert not used[2] & used[5] and not (used[2] | used[5]) & set(first[groups == 1].tolist())


def recall_by_length(path):
    """words -> (pairs of different lines at the edit similarity, those that meet), over all pairs."""
    texts = pq.read_table(path).column("text").to_pylist()
    counted = [n for t in texts if t for x in t.split("\n") if (n := lines.normal_line(x))]
    codes = line_codes(counted)
    keys = sorted(codes, key=lambda k: codes[k][0])
    words = [k.split() for k in keys]
    size = np.array([len(w) for w in words])
    ids = {}
    counts = np.stack([np.bincount([ids.setdefault(w, len(ids)) & 255 for w in x], minlength=256) for x in words]).astype(np.int32)
    out = {}
    for i in range(len(keys)):
        js = np.arange(i + 1, np.searchsorted(size, size[i] / lines.SIMILARITY + 1))
        js = js[np.abs(counts[js] - counts[i]).sum(axis=1) <= 2 * lines.most_edits(size[js], lines.SIMILARITY)]
        for j in js.tolist():
            if lines.edit_similarity(words[i], words[j], lines.SIMILARITY):
                name = next(n for n in (20, 50, 100, 10**9) if size[j] < n)
                pairs, met = out.get(name, (0, 0))
                out[name] = pairs + 1, met + meet(codes[keys[i]], codes[keys[j]])
    return out


def test_recall_of_line_pairs():
    found = recall_by_length("/root/testdata/sf0.01/documents.parquet")
    print("line pairs by words, those found:", sorted(found.items()))
    assert sum(n for n, _ in found.values()) > 300
    assert sum(m for _, m in found.values()) >= 0.93 * sum(n for n, _ in found.values())
    assert all(m >= 0.8 * n for n, m in found.values())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.sampled_from([0.5, 0.8, 0.9]))
def test_edit_similarity(a, b, least):
    longest = max(len(a), len(b))
    assert lines.edit_similarity(a, b, least) == (distance(a, b) <= int((1 - least) * longest + 1e-9))


def test_long_lines_hash_like_short_ones():
    long = " ".join(f"w{i % 700}" for i in range(2000))
    one = lines.line_hashes(pa.array([long], pa.large_string()))
    many = lines.line_hashes(pa.array(["a", "", long, "b c", long.upper()], pa.large_string()))
    assert one[0][0] == many[0][2] == 2000
    for x, y in zip(one[1:], many[1:]):
        assert x[0] == y[2] == y[4]


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5300)] + [(9, 9)]
    groups = Groups()
    for a, b in edges:
        if a != b:
            groups.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: groups.find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark):
    """Each stage on what the one before kept; each against brute force or its own operator."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = docs = corpus_pipeline.stored(stage(spark, docs, SF), f"test-{name}")
    text = {n: {r.doc_id: r.text for r in d.collect()} for n, d in kept.items() if n != "packing"}
    source = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in QUERIES["op5_quality_classifier"](spark, SF).where("predicted = 1").collect()}
    assert set(text["quality"]) == good and all(d.columns == source.columns for n, d in kept.items() if n != "packing")
    assert text["line_dedup"] == brute_lines(sorted(text["quality"].items()))
    assert set(text["near_duplicates"]) == {g for *_, g in brute_near(sorted(text["line_dedup"].items())).values()}
    assert {r.doc_id for r in kept["packing"].collect()} == set(text["near_duplicates"])
    assert len(corpus_pipeline.run(spark, SF).collect()) == kept["packing"].count()


def test_pipeline_of_odd_rows(spark):
    """Nulls, empty and repeated rows, extra columns with clashing names, a struct with odd field names, an empty table."""
    texts = ["", None, "...", "word", "same line\nsame line\nother", *["again and again the same text of some more words here"] * 6, "long " * 20_000, *family(31, 12, 80, 1)]
    rows = [(k, t, "en", None, len(t or ""), f"g{k}", None if k % 2 else 1, (k, "x")) for k, t in enumerate(texts)]
    rows += [(None, "no id", None, "s", 5, None, None, None), (3, "word", "en", "s", 4, "g", 7, (1, "y"))]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, gone string, version int, label struct<`a b`:int,`c.d`:string>"
    docs = spark.createDataFrame(rows, kinds).repartition(3)
    for start in (docs, docs.limit(0)):
        kept = start
        for name, stage in corpus_pipeline.STAGES:
            before = kept
            kept = corpus_pipeline.stored(stage(spark, kept, SF), f"odd-{name}")
            if name != "packing":
                assert kept.columns == docs.columns and kept.schema["label"].dataType == docs.schema["label"].dataType
                assert kept.count() <= before.count()
            if name == "line_dedup":
                assert kept.count() == before.count()
        ids = {r.doc_id for r in kept.collect()}
        assert ids <= {r.doc_id for r in before.collect()} and bool(ids) == bool(start.count())

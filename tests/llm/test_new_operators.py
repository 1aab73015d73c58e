"""Fill-in-the-middle, conversation tries and SimHash components against brute force."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
import xxhash

from corpus_select.llm import conversation_trie, fim, simhash
from corpus_select.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_fim(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle_of_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = QUERIES["op11_fill_in_middle"](spark, SF).collect()
    assert len(found) == len(docs)
    for r in found:
        n, form, pre, mid, out = brute_fim(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, pre, mid, sha(out), sha(docs[r.doc_id] or ""))


ODD = ["", None, "\n", "\n\n\n", "one", "one\n", "a\nb", "é𝄞\r\nß\n\nx", "x<P>y\nz", "<S>", "a\n<M", "<P\n>", "line\n" * 30000, "w" * 100_000, "a\n\x0b b\nc<", "s" * 50 + "\n<S"]


def test_fill_in_middle_of_odd_texts(spark):
    rows = [(k, t, "n", 5) for k, t in enumerate(ODD * 6)] + [(None, "a\nb\nc", "x", 1), (3, "a\nb\nc", "x", 1), (3, "a\nb\nc", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id int, text string, form string, n int").repartition(5)
    for rate, spm in ((100, 50), (60, 0), (100, 100), (0, 50)):
        cut = fim.fill_in_middle(df, rate=rate, spm_rate=spm)
        got = cut.select("*", fim.restored(cut.output, cut.form).alias("again")).collect()
        key = str
        want = sorted(((k, *brute_fim(k, t, rate, spm), t or "") for k, t, *_ in rows), key=key)
        assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in got), key=key) == want
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_fill_in_middle_by_other_units(spark):
    df = spark.createDataFrame([(1, "ab cd ef"), (2, "")], "k long, body string")
    words = fim.fill_in_middle(df, "k", "body", unit=r"\S+\s*|\s+", marks=("[pre]", "[suf]", "[mid]"))
    r = words.where("doc_id = 1").select("*", fim.restored(words.output, words.form, ("[pre]", "[suf]", "[mid]")).alias("again")).first()
    assert r.n == 3 and r.again == "ab cd ef" and r.output.count("[mid]") == 1
    with pytest.raises(ValueError):
        fim.fill_in_middle(df, "k", "body", marks=("ab", "ba", "c"))
    with pytest.raises(ValueError):
        fim.cut("a b", fim.draws(1, 7), fim.regex.compile("([ab])*"))


def brute_code(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    pieces = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(codes, first, radius=3):
    """code -> least id reachable."""
    codes = np.array(sorted(codes), np.uint64)
    label = list(range(len(codes)))
    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i] ^ codes[i + 1:]) <= radius):
            a, b = label[i], label[i + 1 + int(j)]
            if a != b:
                label = [a if x == b else x for x in label]
    least = {}
    for c, k in zip(codes.tolist(), label):
        ids = [i for i in (least.get(k), first[c]) if i is not None]
        least[k] = min(ids) if ids else None
    return {c: least[k] for c, k in zip(codes.tolist(), label)}


def check_simhash(rows, found):
    codes = [brute_code(t) for _, t in rows]
    first = {}
    for (k, _), c in zip(rows, codes):
        ids = [i for i in (first.get(c), k) if i is not None]
        first[c] = min(ids) if ids else None
    root = brute_components(set(codes), first)
    assert sorted(map(str, found)) == sorted(str((k, f"{c:016x}", root[c])) for (k, _), c in zip(rows, codes))


def test_simhash_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = [(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op13_simhash_near_dedup"](spark, SF).collect()]
    check_simhash(rows, found)


def test_simhash_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 700)]
    near = []
    for _ in range(60):
        own = list(base)
        for i in rng.integers(0, 700, 2):
            own[i] = f"e{rng.integers(0, 10**9)}"
        near.append(" ".join(own))
    texts = [*near, "", None, " \t\n", "A b C", "a B c", "ÉA b", "a b c", "a\x0bb\x0cc", "x y", "x", "word " * 30000, "b\x1cc d e", *["again and again the same"] * 30]
    rows = list(enumerate(texts)) + [(None, "no id here at all"), (None, "a b c"), (2, "repeated id of this row"), (2, "repeated id of this row")]
    df = spark.createDataFrame([(k, t, "c", 1) for k, t in rows], "doc_id long, text string, code string, root int").repartition(7)
    found = simhash.near_duplicates(df, block=16)
    assert found.columns == ["doc_id", "code", "n_copies", "component_id"]
    check_simhash(rows, [(r.doc_id, f"{r.code & (1 << 64) - 1:016x}", r.component_id) for r in found.collect()])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def balls(rng, n):
    """Codes around few centres, and unrelated ones."""
    centres = rng.integers(0, 2**64, 6, dtype=np.uint64)
    out = set(rng.integers(0, 2**64, n // 3, dtype=np.uint64).tolist())
    while len(out) < n:
        c = int(centres[rng.integers(0, 6)])
        for b in rng.integers(0, 64, rng.integers(0, 7)):
            c ^= 1 << int(b)
        out.add(c)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("block", [32, 300, 5000])
def test_gray_links_connect_what_brute_force_connects(spark, block):
    codes = balls(np.random.default_rng(block), 2500)
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code long").repartition(6)
    links = [(r.a, r.b) for r in simhash.gray_links(df, len(codes), block=block).collect()]
    assert len(links) < 40 * len(codes)
    signed = dict(zip(codes.view(np.int64).tolist(), range(len(codes))))
    sets = simhash.Sets(len(codes))
    a, b = (np.array([signed[l[k]] for l in links]) for k in (0, 1))
    sets.join(a, b)
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= 3
    want = simhash.Sets(len(codes))
    want.join(*np.nonzero(near))
    assert (sets.label == want.label).all()


def test_gray_order_and_nodes():
    codes = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    rank = simhash.gray_rank(codes)
    assert ((rank ^ rank >> np.uint64(1)) == codes).all()
    codes = codes[np.argsort(rank)]
    tree = simhash.Tree(codes)
    for width in tree.widths:
        starts = np.arange(0, len(codes), width)
        for s, m, v in itertools.islice(zip(starts.tolist(), *simhash.node(codes, starts)), 0, None, 37):
            assert ((codes[s:s + width] & m) == v).all()
    starts = np.arange(0, len(codes), 40)
    masks, values = simhash.node(codes, starts)
    roots = simhash.Roots(np.arange(len(starts)), masks, values)
    for k in range(0, len(starts), 11):
        assert roots.near(masks[k], values[k], 3).tolist() == np.flatnonzero(np.bitwise_count((values ^ values[k]) & masks & masks[k]) <= 3).tolist()


def test_majority_of_long_and_empty_groups():
    rng = np.random.default_rng(2)
    per = np.array([0, 1, 2, 700, 0, 255, 256, 300_000, 3])
    h = rng.integers(0, 2**64, per.sum(), dtype=np.uint64)
    got, at = simhash.majority(h, per), 0
    for n, code in zip(per.tolist(), got.tolist()):
        own = h[at:at + n]
        at += n
        assert code == sum(1 << b for b in range(64) if 2 * int((own >> np.uint64(b) & np.uint64(1)).sum()) > n)


def rebuilt(turns, rule):
    """conv -> rebuilt turns; rows are (conv, turn, role, text) without ties in turn."""
    own = {}
    for c, t, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1] if x[0] else 0))] for c, v in own.items()}
    return {c: [*own.get(rule(c)[0], [])[:rule(c)[1]], *v[rule(c)[1]:]] for c, v in own.items()}


def brute_trie(full):
    members, ends = {}, {}
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members.setdefault(tuple(full[c][:d]), []).append(c)
        ends.setdefault(tuple(full[c]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        out[node] = (len(below), sum(out[b][1] for b in below) or 1, own + sum(out[b][2] for b in below))
    return sorted((members[node][0], len(node), members[node[:-1]][0] if node else -1, len(members[node]), *out[node], sha(",".join(map(str, ends.get(node, []))))) for node in members)


def trie_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def dealt_rule(c):
    return c - c % 5, zlib.crc32(str(c).encode()) % 9


def test_trie_of_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(QUERIES["op12_conversation_prefix_trie"](spark, SF)) == brute_trie(rebuilt(rows, dealt_rule))


def odd_conversations():
    rng = np.random.default_rng(9)
    rows = []
    for c in range(300):
        if c % 17 == 0 and c:  # absent, bases among them
            continue
        start = ["hello", "hello", "hi", "", None][c % 5 if c % 3 else 0]
        for t in range(int(rng.integers(1, 14))):
            rows.append((c, t if t else [0, None][c % 2], "user" if t % 2 == 0 else None, start if t == 0 else f"w{int(rng.integers(0, 2))}é"))
    rows += [(1000, t, "a", "same") for t in range(700)] + [(1005 + 5 * k, t, "a", "same") for k in range(3) for t in range(400 + k % 2)]
    rows += [(None, 1, "a", "lost"), (10**15, 3, "long", "x" * 50_000), (7, 100, "user", "tail"), (7, 101, "user", "tail")]
    return rows


@pytest.mark.parametrize("parts", [1, 9])
def test_trie_of_odd_conversations(spark, parts, monkeypatch):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, conv string, depth int").repartition(parts)
    conv = conversation_trie.F.col("conv")
    head = conversation_trie.F.crc32(conv.cast("string")) % 9
    monkeypatch.setattr(conversation_trie, "BLOCK", 16)
    monkeypatch.setattr(conversation_trie, "PIECE", 3)
    monkeypatch.setattr(conversation_trie, "HEAVY", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # conversations then go over several partitions
    try:
        assert trie_rows(conversation_trie.prefix_trie(df, conv - conv % 5, head)) == brute_trie(rebuilt(rows, dealt_rule))
        assert trie_rows(conversation_trie.prefix_trie(df)) == brute_trie(rebuilt(rows, lambda c: (c, 0)))
        assert conversation_trie.prefix_trie(df.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_keeps_repeated_rows_and_ties(spark):
    rows = [(1, 0, "u", "a"), (1, 0, "u", "a"), (1, 0, "u", "b"), (2, 0, "u", "b"), (2, 0, "u", "a"), (2, 0, "u", "a")]
    found = trie_rows(conversation_trie.prefix_trie(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")))
    assert [r[:2] + r[3:6] for r in found] == [(1, 0, 2, 1, 1), (1, 1, 2, 1, 1), (1, 2, 2, 1, 1), (1, 3, 2, 0, 1)]  # one order for both


def test_trie_finds_clashes(spark, monkeypatch):
    rows = odd_conversations()[:600]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = brute_trie(rebuilt(rows, lambda c: (c, 0)))
    monkeypatch.setattr(conversation_trie, "ATTEMPTS", 3)
    with pytest.raises(RuntimeError):
        conversation_trie.prefix_trie(df, hash_bits=1)
    monkeypatch.setattr(conversation_trie, "ATTEMPTS", 60)
    assert trie_rows(conversation_trie.prefix_trie(df, hash_bits=3)) == want


def test_arithmetic_modulo_the_prime():
    rng = np.random.default_rng(3)
    p = conversation_trie.PRIME
    a, b = (np.concatenate([rng.integers(0, p, 1000, dtype=np.uint64), np.array([0, 1, p - 1, p - 1], np.uint64)]) for _ in range(2))
    assert conversation_trie.mul(a, b).tolist() == [int(x) * int(y) % p for x, y in zip(a, b)]
    assert conversation_trie.sub(a, b).tolist() == [(int(x) - int(y)) % p for x, y in zip(a, b)]
    assert conversation_trie.powers(12345, np.array([0, 1, 7, 10**6])).tolist() == [pow(12345, e, p) for e in (0, 1, 7, 10**6)]

"""Extraction, fingerprints, quality and licence scans against brute force."""

import hashlib
import html
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpus_select.llm import extraction, fingerprints, licenses, quality
from corpus_select.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"

PAGE = ('<html><body class="x"><div id="cookie-notice">We use</div><header><h1>Site</h1></header><div class="layout"><main class="col-8"><article class="post post-12"><h1>T &amp; x</h1>'
        '<p>One<br>two <a href=x>li</a>nk <span class="ad">AD</span> end</p><ul><li>a<li>b</ul><script>var t="</p>";</script><section class="comments"><p>hey</p></section></article></main>'
        '<div class="sidebar"><p>side text that is long enough to look like an article, twice, thrice</p></div></div><form>f</form><footer>c</footer></body>')


def test_extraction_of_pages(spark):
    rows = {r.page_id: r for r in QUERIES["op2_html_extraction"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", p.html, re.S)[1]
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", x)))).strip() for x in re.split(r"</?(?:p|h1)>", inner))
        want = "\n".join(x for x in parts if x)
        assert tuple(rows[p.page_id]) == (p.page_id, p.url, want, len(want))


def test_extraction_cases(spark):
    lone = '<html><body><div class="story-77"><p>Only   here &lt;b&gt;</p></div></body></html>'
    rows = [(1, "http://h.org/1", PAGE, "n"), (1, "http://h.org/1", PAGE, "n"), (2, "http://h.org/2", lone, None), (3, None, None, None), (4, "http://h.org/4", "", None), (None, "not a url", "plain <b>text", None),
            (5, "http://[bad", "<p", None), (6, "http://h.org/6", "<body><article>" + "<div>" * 3000 + "deep" + "</article>", None)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, path string")
    got = sorted((r.page_id or 0, r.text) for r in extraction.extract(df).collect())
    body = "T & x\nOne two link end\na\nb"
    assert got == [(0, "plain text"), (1, body), (1, body), (2, "Only here <b>"), (3, ""), (4, ""), (5, ""), (6, "deep")]
    assert extraction.extract(df.limit(0)).count() == 0


W = "word " * 30


def main_text(page):
    found = extraction.blocks(page)
    return extraction.take(found, extraction.best(extraction.container_scores(found)))


LONG = ("more " * 90).strip()
WORDS = W.strip()
TEMPLATES = {
    "nested body": (f"<body><article><h1>T</h1><p class=lead>Lead {W}</p><div class=c><div class=body><p>{W}</p><p>{LONG}</p></div></div><p>close</p></article></body>",
                    ["T", f"Lead {WORDS}", WORDS, LONG, "close"]),
    "sibling containers": (f"<body><div class=a><div class=b1><p>{W}</p></div><div class=x><div class=y><div class=z><p>{LONG}</p></div></div></div></div></body>", [WORDS, LONG]),
    "own header": (f"<body><header><h1>Site</h1></header><article><header><h1>Title <b>b</b></h1><p>by me</p></header><p>{W}</p></article>", ["Title b", WORDS]),
    "words of classes": (f"<body><article><p class='share-price'>share {W}</p><div class=legal-analysis><p>legal</p></div><div class='x share-buttons'>Share</div><div class=comments>c</div>"
                         f"<div class='site-footer_inner'>f</div><p>{W}</p></article>", [f"share {WORDS}", "legal", WORDS]),
    "open quote": (f'<body><article><p title="x>hello</p><p>{W}</p><p title="a > b">ok</p></article></body>', ["hello", WORDS, "ok"]),
    "sections of main": (f"<main><section><h2>A</h2><p>{W}</p></section><section><h2>B</h2><div><p>{LONG}</p></div></section><nav>n</nav></main><div class=sidebar><p>{LONG}</p></div>", ["A", WORDS, "B", LONG]),
    "links around": (f"<body><div class=page><div class=top><a href=1>one two three</a> <a href=2>four</a></div><div class=text><p>{W}</p></div></div></body>", [WORDS]),
    "deep": ("<body>" + "<div>" * 12 + f"<p>{W}</p><div><p>{LONG}</p></div>" + "</div>" * 12, [WORDS, LONG]),
    "table and lists": (f"<body><div id=content><ul><li>{W}</li><li>b</li></ul><table><tr><td>c<td>d</table><blockquote>{LONG}</blockquote></div></body>", [WORDS, "b", "c", "d", LONG]),
}


@pytest.mark.parametrize("name", TEMPLATES)
def test_templates_keep_the_article(name):
    page, want = TEMPLATES[name]
    assert main_text(page).split("\n") == want


def test_templates_through_the_vote(spark, monkeypatch):
    rows = [(i, f"http://h{i}.org/", page) for i, (page, _) in enumerate(TEMPLATES.values())]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3)
    want = {i: "\n".join(w) for i, (_, w) in enumerate(TEMPLATES.values())}
    for hosts in (extraction.MAX_HOSTS, 2):  # paths shipped, and joined
        monkeypatch.setattr(extraction, "MAX_HOSTS", hosts)
        assert {r.page_id: r.text for r in extraction.extract(df).collect()} == want


def test_hosts_agree_on_their_path(spark):
    page = '<body><div class="box-{0}"><p>{1}</p></div><div class="rail"><p>{2}</p></div></body>'
    long, short = "long article words " * 20, "rail " * 12
    rows = [(i, "http://a.com/x", page.format(i, long, short)) for i in range(9)] + [(9, "http://a.com/y", page.format(9, "short article", "rail " * 40))]
    got = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got[9] == "short article" and got[0] == long.strip()


def shingles(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_fingerprints(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    rows = sorted(((r.doc_id, r.text) for r in df.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.compare_with_next(df.repartition(5)).collect()}
    errors = []
    for i, (k, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1]
        edited = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[k].n_chars == len(t)
        a, b, c = shingles(t), shingles(edited), shingles(n)
        errors += [got[k].near_edited - len(a & b) / len(a | b), got[k].near_next - len(a & c) / len(a | c)]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04 and np.abs(errors).max() < 0.15
    same = {}
    for k, t in rows:
        same.setdefault(t, set()).add(got[k].fingerprint)
    assert all(len(v) == 1 for v in same.values()) and len({x for v in same.values() for x in v}) == len(same)
    alone = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(df).collect()}
    assert all(alone[k] == got[k].fingerprint for k in got)


def test_fingerprint_cases(spark):
    rows = [(5, "a b c", "x"), (5, "a b c", "x"), (4, None, "y"), (3, "", None), (2, " \n ", None), (None, "zz " * 60000, None), (1, "é" * 7, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, fingerprint string")
    got = fingerprints.compare_with_next(df.repartition(3)).collect()
    assert len(got) == 7
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.fingerprint for r in by[5]] == [by[5][0].fingerprint] * 2
    assert by[4][0].fingerprint == by[3][0].fingerprint == by[2][0].fingerprint and by[4][0].near_next == 1.0
    assert by[1][0].edited_sha256 == hashlib.sha256(("é" * 4 + "zz ").encode()).hexdigest()
    assert fingerprints.compare_with_next(df.limit(0)).count() == 0
    lone = fingerprints.compare_with_next(df.where("doc_id = 1")).collect()
    assert lone[0].near_next == 1.0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op5_quality_classifier"](spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [p for p, y in held if y == 1], [p for p, y in held if y == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_quality_ignores_held_out_labels_and_other_columns(spark):
    docs = spark.createDataFrame([(i, ("good words in a row " if i % 3 else "### $$$ %%% ") * (5 + i % 7), i % 3) for i in range(400)] + [(None, None, 0), (7, "", 1)], "doc_id int, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(None, 1), (3, None), (9999, 0)], "doc_id int, quality int")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    first = sorted((r.doc_id or -1, r.score) for r in quality.classify(docs, labels).collect())
    again = sorted((r.doc_id or -1, r.score) for r in quality.classify(docs.repartition(7), flipped).collect())
    assert first == again and len(first) == 402
    assert all((s > 0.5) == (i % 3 > 0) for i, s in first if i > 10)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.where("doc_id > 10").collect()} == {i for i in range(11, 400) if i % 3}
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_feature_rows_match_their_texts():
    texts = ["", "one", "A B!\nA B!", "日本 語|x", "word " * 1000]
    whole = quality.text_features(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], quality.text_features(pa.array([t], pa.large_string()))[0])
        assert np.allclose(whole[i], quality.text_features(pa.array(["pad", t, "pad"], pa.large_string()).slice(1, 1))[0])


def test_license_scan(spark):
    mit = dict(licenses.LICENSE_TEXTS)["MIT"]
    rows = [(1, "MIT License\n", "q"), (2, "Copyright (c) 2020 Me. All rights reserved.\n\n" + mit.upper().replace("\n", "\n\n"), None), (3, None, None), (4, "", None), (5, "text\nReleased  under the MIT licence!!\nAll rights reserved", None),
            (5, "more\nlicensed under cc by-nc 4.0", None), (6, mit + " more", None), (None, "(c) 1999", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, license string")
    got = {r.doc_id: (r.text_license, r.line_licenses, r.n_license_lines) for r in licenses.scan(df).collect()}
    assert got == {1: ("MIT", "MIT", 1), 2: ("MIT", "", 0), 3: (None, "", 0), 4: (None, "", 0), 5: (None, "CC-BY-NC-4.0,MIT,all-rights-reserved", 3), 6: (None, "", 0), None: (None, "", 0)}
    assert licenses.scan(df.limit(0)).count() == 0
    own = spark.createDataFrame([("house", "Ask the owner of the programme.")], "license string, text string")
    asked = spark.createDataFrame([(1, "ask THE holder, of the program")], "doc_id int, text string")
    assert licenses.scan(asked, own).first().text_license == "house"
    plan = licenses.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_entire_licenses_with_titles(spark):
    """LICENSE files as they are published: title, copyright line, reservation, body; long ones whole."""
    bodies = dict(licenses.LICENSE_TEXTS)
    files = [("MIT", "MIT License\n\nCopyright (c) 2020 Me\n\n"), ("MIT", "The MIT License (MIT)\n=====\n\nCopyright (c) 2020 Me\nAll rights reserved.\n\n"), ("ISC", "ISC License\n\nCopyright 2020 Me\n\n"),
             ("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright (c) 2020, Me\nAll rights reserved.\n\n"), ("BSD-3-Clause", "Copyright (c) 2020, Me\nAll rights reserved.\n\n"), ("Zlib", "zlib License\n\n(C) 2020 Me\n\n")]
    texts = [(lic, head + bodies[lic] + "\n") for lic, head in files]
    texts += [("BSD-3-Clause", "BSD 3-Clause License\n\n" + re.sub(r"\n\d\. ", "\n* ", bodies["BSD-3-Clause"]))]
    for lic, start, end in (("Apache-2.0", "Apache License", "limitations under the License."), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE", "instead of this License."), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE", "why-not-lgpl.html>."),
                            ("LGPL-2.1", "GNU LESSER", "all there is to it!"), ("LGPL-3.0", "GNU LESSER", "Library."), ("MPL-2.0", "Mozilla Public License", "Mozilla Public License, v. 2.0."), ("CC0-1.0", "Creative Commons", "CC0 or use of the Work.")):
        text = dict(licenses.entire_texts()[-len(licenses.ENTIRE):])[lic]
        assert text.strip().startswith(start) and text.strip().endswith(end), lic
        texts.append((lic, "\n\n" + text.replace("\n", "\n\n")))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)] + [(99, "MIT License\n" + bodies["MIT"] + " more")], "doc_id int, text string")
    got = {r.doc_id: r.text_license for r in licenses.scan(df).collect()}
    assert got == {**{i: lic for i, (lic, _) in enumerate(texts)}, 99: None}


def test_license_twin(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, QUERIES["op7_license_scans"](spark, SF).collect()), key=str) == sorted(con.execute(licenses.scan_sql()).fetchall(), key=str)


def plain_features(text):
    """The features of one text, counted character by character and word by word."""
    raw, chars = text.encode(), len(text)
    size = max(len(raw), 1)
    words = re.split(r"[ \t\n\v\f\r]+", text) if text else [""]
    count = {w: words.count(w) for w in words}
    n = len(words)
    lines = text.split("\n")
    ascii_symbols = {c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in ".,;:'\"-?()"}
    share = lambda test: sum(map(test, raw)) / size
    return [np.log1p(chars), np.log1p(n), sum(map(len, words)) / n, share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), share(lambda b: b in b"\t\n\v\f\r "),
            share(lambda b: chr(b) in ascii_symbols and b < 128), share(lambda b: b >= 128), len(count) / n, max(count.values()) / n, sum(len(w) <= 2 for w in words) / n,
            sum(len(w) > 12 for w in words) / n, 1 - len(set(lines)) / len(lines), np.log1p(chars / len(lines)), sum(bool(re.search("[.!?:;\"')]\\s*$", x)) for x in lines) / len(lines),
            sum(bool(re.search("[#$%&*|!<>{}=_~^@+]", w)) for w in words) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
            sum(bool(re.search("^[A-ZÀ-ÖØ-Þ]{2,}[^a-zß-öø-ÿ]*$", w)) for w in words) / n, share(lambda b: b == 124), share(lambda b: b == 33)]


def plain_score(model, x):
    """A sum of looked-up table entries, one at a time."""
    bins = [sum(float(v) >= e for e in edges.tolist()) for v, edges in zip(x, model.edges)]
    z = model.base + sum(float(t[b]) for t, b in zip(model.mains, bins)) + sum(float(t[model.coarse[f][bins[f]], model.coarse[g][bins[g]]]) for f, g, t in model.pairs)
    return 1 / (1 + np.exp(-z))


def test_quality_scores_against_plain_lookups(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    odd = ["", "a", "A|B!!", " lead", "trail ", "x\n\nx\n", "ÉCOLE 12 école", "tab\tand\vfeed\f", "#tag #tag", "one two two two"]
    got = quality.text_features(pa.array([t or "" for _, t in rows] + odd, pa.large_string()))
    want = np.array([plain_features(t or "") for _, t in rows] + [plain_features(t) for t in odd])
    assert np.allclose(got, want, atol=1e-9), [quality.FEATURES[k] for k in np.flatnonzero(~np.isclose(got, want).all(axis=0))]
    model = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert model.mains and model.pairs
    scores = {r.doc_id: r.score for r in QUERIES["op5_quality_classifier"](spark, SF).collect()}
    for (k, _), x in zip(rows, want.astype(np.float32)):
        assert abs(scores[k] - plain_score(model, x)) < 1e-9

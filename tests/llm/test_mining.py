"""Spelling variants, URL filters and hard negatives: against plain loops, and on rows that could break them."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from farfield.llm import negatives, spelling, urls


def plain_words(rows, modulus, least):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a != b and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])


def plain_variants(words, times):
    out = {}
    for w, n in words.items():
        near = sorted((-words[v], v) for v in words if one_edit(w, v))
        form = near[0][1] if near and -near[0][0] >= times * n else None
        out[w] = [form, None, n, len(near), words[form] if form else None]
    for w, row in out.items():
        while out[w][0]:
            w = out[w][0]
        row[1] = w
    return {w: tuple(r) for w, r in out.items()}


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdeéñ×") for _ in range(rng.randint(6, 9))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "aaaaaaab", "baaaaaa"]
    words = []
    for s in stems:
        for _ in range(rng.choice([1, 2, 12])):
            words += [s] * rng.choice([1, 4, 30])
            k = rng.randrange(len(s))
            words += [s[:k] + rng.choice(["", "z", "zé"]) + s[k + rng.randint(0, 1) :]] * rng.randint(1, 3)
    words += [s.upper() for s in stems] + ["chained"] * 80 + ["chainedx"] * 20 + ["chainedxy"] * 5
    # many words with one half in common, so that groups must be halved again
    words += ["common" + x + y for x in "abcdefgh" for y in "abcdefgh"] + [x + "stemmed" for x in "abcdefgh"]
    rng.shuffle(words)
    rows = [(k, " 1-".join(words[k::17])) for k in range(17)]
    return rows + [(20, None), (21, ""), (None, "nameless nameless"), (3, rows[3][1]), (22, "wordless" * 3000 + " " + "wordless" * 3000)]


@pytest.mark.parametrize("hot", [3, 4096])
def test_variants_match_plain_loops(spark, spelled, hot):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in spelled], "doc_id long, text string, n long, word string").repartition(3)
    want = plain_variants(plain_words(spelled, 7, 2), 2)
    rows = spelling.variants(docs, modulus=7, least_count=2, times=2, hot=hot).collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert got == want and len(rows) == len(got)
    assert any(r[0] and r[1] != r[0] for r in want.values()) and max(r[3] for r in want.values()) > 5


def test_groups_are_bounded(spark):
    words = spark.createDataFrame([("same" + f"{k:05d}".translate(str.maketrans("0123456789", "abcdefghij")) + "tail", 5) for k in range(3000)], "word string, n long")
    sizes = spelling.grouped(words, hot=64).groupBy("key").count().agg({"count": "max"}).first()[0]
    assert sizes <= 100
    # of the five letters the first is always the same, the second one of three, the others one of ten
    assert {r["n_near"] for r in spelling.near_words(words, hot=64).collect()} == {2 + 3 * 9}


def test_no_words(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(docs).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "short 12 words")], docs.schema)).count() == 0


PAGES = [
    (1, "http://A.Example.net/en/x?y", None), (2, "http://a.example.net/en", ""), (3, "https://example.com/de/", "x"), (4, "https://myexample.com/de/1", "x"),
    (5, "//no.scheme/", "x"), (6, None, "x"), (7, "http://net", "x"), (8, "http://net/", "x"), (9, "ftp://x.org/fr/1#http://b", "x"), (10, "http://x.org?/fr/", "x"),
    (10, "http://x.org?/fr/", "x"), (None, "odd://u@Host:80", "x"), (11, "http://planet/q", "<a" + " " * 50_000 + "href=" + " " * 50_000), (12, "", "x"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(*p, "h", "r") for p in PAGES], "page_id long, url string, html string, host string, rule string")
    rows = urls.judge(pages).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == len(PAGES)
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("a.example.net", "/en", "net/", "block")
    assert got[3] == ("example.com", "/de/", "example.com/de/", "block") and got[4] == ("myexample.com", "/de/1", None, "allow")
    assert got[5] == got[6] == got[12] == ("", "", None, "allow") and got[8] == ("net", "/", "net/", "block")
    assert got[7] == ("net", "", None, "allow")  # as many blocked pages as others: not more than half
    assert got[9] == ("x.org", "/fr/1", "org/fr/", "allow") and got[10][:3] == ("x.org", "", None) and got[None][:2] == ("u@host:80", "") and got[11][3] == "allow"
    assert urls.judge(pages.where("false")).count() == 0


def test_links(spark):
    html = """<a HREF = 'http://B.example/x'>b</a><a href=//c.example?q>c</a><img src="https://b.example">
        <a href="/own">own</a><a href="http://a.example/y">own</a><a data-href='x'>no</a><a href="mailto:x@d.example">no</a>"""
    pages = spark.createDataFrame([(1, "http://a.example/1", html), (2, "http://a.example/2", html), (3, None, html), (4, "http://c.example", None)], "page_id long, url string, html string")
    assert sorted((r["src"], r["dst"], r["n"]) for r in urls.links(pages).collect()) == [("a.example", "b.example", 2), ("a.example", "c.example", 2)]


def test_propagation_matches_plain_iteration(spark):
    rng = random.Random(3)
    n = 40
    edges = Counter((rng.randrange(n - 4), rng.randrange(n)) for _ in range(160))
    edges = {(f"h{a}", f"h{b}"): k for (a, b), k in edges.items() if a != b} | {(f"h{k}", "h39"): 5 for k in range(30)}
    names = [f"h{k}" for k in range(n)]
    seeds = {h: (float(k % 3 == 0) * k, float(k % 4 == 1) * 2) for k, h in enumerate(names)}
    w = np.zeros((n, n))
    for (a, b), k in edges.items():
        w[int(a[1:]), int(b[1:])] = k
    ahead, back = (np.divide(m, m.sum(1, keepdims=True), out=np.zeros_like(m), where=m.sum(1, keepdims=True) > 0) for m in (w, w.T))
    want = []
    for matrix, c in ((ahead, 0), (back, 1)):
        s = np.array([seeds[h][c] for h in names])
        y = np.linalg.solve(np.eye(n) - 0.85 * matrix.T, s)
        want.append(y * s.sum() / y.sum())
    frame = spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust double, distrust double")
    links = spark.createDataFrame([(a, b, k) for (a, b), k in edges.items()], "src string, dst string, n long")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urls.propagate(frame, links, left=1e-4).collect()}
    for c in (0, 1):
        assert np.allclose([got[h][c] for h in names], want[c], atol=2e-3 * want[c].sum())


def test_hosts_that_link_to_blocked_ones_are_blocked(spark):
    page = lambda i, host, *to, path="/": (i, f"http://{host}{path}", "".join(f"<a href='http://{t}/'>x</a>" for t in to))
    rows = [page(k, f"s{k % 3}.net") for k in range(30)] + [page(30, "farm.io", "s0.net", "s1.net", "s2.net"), page(31, "feeder.io", "farm.io"), page(32, "fair.io", "good.org")]
    rows += [page(40 + k, "good.org", "fair.io", path="/fr/") for k in range(10)] + [page(60, "good.org", "s0.net", path="/en/"), page(61, "alone.io")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages).collect()}
    assert got[30] == got[31] == (None, "block") and got[32] == got[60] == got[61] == (None, "allow")
    assert got[0] == ("net/", "block") and got[40] == ("org/fr/", "allow")


def plain_negatives(rows, every, n):
    rows = sorted({(i, (y + 1) % 10 if i % 7 == 0 else y, tuple(int(np.floor(256 * float(x))) for x in v)) for i, y, v in rows if None not in (i, y, v) and all(x is not None and np.isfinite(x) for x in v)})
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for a in rows:
        if a[0] % every:
            continue
        ranked = sorted({(-score(a[2], b[2]), b[0], b[1] == a[1]) for b in rows if b[0] != a[0]})
        for p, i, _ in [r for r in ranked if r[2]][:n]:
            far = [r for r in ranked if not r[2] and 80 * -p <= 100 * -r[0] <= 100 * -p][:n]
            out |= {(a[0], i, k + 1, j, -p, -s) for k, (s, j, _) in enumerate(far)}
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 9))
    rows = [(k, int(rng.integers(0, 4)), [float(np.float32(x)) for x in centres[k % 12] + rng.normal(size=9) * rng.choice([0, 0.02, 0.5])]) for k in range(900)]
    rows += [(902, 1, None), (903, None, rows[3][2]), (None, 1, rows[3][2]), (904, 1, [None] * 9), (905, 1, [float("nan")] * 9), (906, 1, [float("inf")] * 9), (910, 1, []), (920, 2, [1.0] * 4), rows[20], rows[21]]
    return rows


@pytest.mark.parametrize(("tree", "passes", "block"), [(512, 1 << 14, 1024), (8, 16, 64), (1, 40, 300)])
def test_negatives_match_plain_loops(spark, vectors, monkeypatch, tree, passes, block):
    for name, value in (("TREE", tree), ("ANCHORS", passes), ("BLOCK", block)):
        monkeypatch.setattr(negatives, name, value)
    frame = spark.createDataFrame([(*r, 1, "t") for r in vectors], "vec_id long, label int, embedding array<float>, id long, tree string").repartition(5)
    rows = negatives.mine(frame, every=10).collect()
    got = {(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in rows}
    assert got == plain_negatives(vectors, 10, 5) and len(rows) == len(got) > 500


def test_bounds_leave_rows_out():
    rng = np.random.default_rng(2)
    x = np.floor(256 * (rng.normal(size=(8, 24)).repeat(40, 0) + 0.01 * rng.normal(size=(320, 24))))
    order, parent, edge = negatives.spanning_tree(x[::4])
    row = {"ids": np.arange(80), "labels": np.zeros(80, np.int64), "parents": parent, "edges": edge, "vectors": x[::4][order]}
    tree = negatives.Tree({k: v.tobytes() for k, v in row.items()}, 24)
    exact = x @ tree.x.T
    low = np.quantile(exact, 0.97, axis=0)
    scored = 0
    for k, rows, scores, n in tree.scores(x, low, np.full(80, np.inf)):
        scored += n
        assert set(np.flatnonzero(exact[:, k] >= low[k])) <= set(rows) and (scores == exact[rows, k]).all()
    assert scored < 0.5 * exact.size


def test_negatives_of_odd_tables(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert negatives.mine(spark.createDataFrame([], schema)).count() == 0
    assert negatives.mine(spark.createDataFrame([(100, 1, [1.0]), (101, 2, [1.0])], schema)).count() == 0
    assert negatives.mine(spark.createDataFrame([(k, k % 2, [0.0, 0.0]) for k in range(99, 104)], schema)).count() == 3

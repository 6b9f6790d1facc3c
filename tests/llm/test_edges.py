"""Nulls, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names, for each operator."""

from __future__ import annotations

import pytest

from farfield.llm import decontam, html_diff, langid, lm, mpeg, ngram_join, packing, pii, quality, rlz_dedup

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
SAME = " ".join(f"tie{i}" for i in range(70))
ROWS = [
    (1, SAME, "en", 1, "k", 5),
    (2, None, "en", 1, "k", 5),
    (3, "", None, 1, "k", 5),
    (4, " \t\n ", "de", 1, "k", 5),
    (5, LONG, "de", 1, "k", 5),
    (6, SAME, None, 1, "k", 5),
    (7, "one", "en", 1, "k", 5),
    (8, "Ünïcödé 日本語 \U0001f600 a@b.example", "fr", 1, "k", 5),
    (8, "Ünïcödé 日本語 \U0001f600 a@b.example", "fr", 1, "k", 5),
    (None, "no id here", "en", 1, "k", 5),
    (9, "0000 1111 !!! ...", "en", 1, "k", 5),
]
#: names that the operators use inside
SCHEMA = "doc_id long, text string, lang string, node long, key string, n long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(2, "doc_id")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in (1, 2, 3, 5, 7, 8, 8)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, SAME), (2, None), (3, ""), (4, "too short"), (4, "too short")], "item_id long, text string")


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x))


ALL = sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))


def test_jaccard(docs):
    out = ngram_join.near_groups(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}
    assert ids(out) == ALL
    assert got[1] == (68, 1) and got[6] == (68, 1) and got[2] == (0, 2) and got[4] == (0, 4) and got[7] == (1, 7) and got[None][1] is None


def test_one_of_each(docs):
    assert ids(ngram_join.one_of_each(docs)) == [1, 2, 3, 4, 5, 7, 8, 9, None]
    assert ngram_join.one_of_each(docs).columns == docs.columns


def test_substrings(docs):
    got = {r["doc_id"]: r for r in rlz_dedup.digest(rlz_dedup.remove_repeats(docs)).collect()}
    assert ids(rlz_dedup.remove_repeats(docs)) == ALL
    assert (got[6]["n_words"], got[6]["n_removed"]) == (70, 70) and got[1]["n_removed"] == 0 and got[8]["n_removed"] == 0 and got[2]["n_words"] == 0


def test_language(docs):
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert ids(langid.identify(docs)) == ALL
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[9]["lang_pred"] == "und" and got[9]["score"] == 0
    assert got[8]["lang_pred"] != "und" and all(0 <= r["score"] <= 1 for r in got.values())


def test_packing(docs):
    rows = packing.pack(docs).collect()
    assert {r["doc_id"] for r in rows} == set(ALL)
    assert sum(r["length"] for r in rows) == sum(n for _, n in {(r["doc_id"], r["doc_tokens"]) for r in rows}) + next(r["doc_tokens"] for r in rows if r["doc_id"] == 8)
    assert next(r["doc_tokens"] for r in rows if r["doc_id"] == 2) == 1


def test_pii(docs):
    out = pii.surrogate(docs)
    assert ids(out) == ALL and out.columns == [*docs.columns, "n_entities"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[2]["text"] is None and got[5]["text"] == LONG and "a@b.example" not in got[8]["text"] and got[8]["n_entities"] == 1


def test_scoring(docs):
    got = {r["doc_id"]: r for r in lm.score(docs).collect()}
    assert ids(lm.score(docs)) == ALL
    assert got[2]["n_tokens"] == got[4]["n_tokens"] == 1 and got[2]["score"] == got[3]["score"] and got[5]["n_tokens"] == 60_001


def test_decontamination(docs, benchmark):
    out = decontam.report(docs, benchmark)
    assert ids(out) == ALL and {r["doc_id"] for r in out.collect() if r["contaminated"]} == {1, 6}
    kept = decontam.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and ids(kept) == [i for i in ALL if i not in (1, 6)]


def test_quality(docs, labels):
    out = quality.score(docs, labels)
    assert ids(out) == ALL and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.collect())
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_media(docs):
    got = {r["doc_id"]: r for r in mpeg.describe(mpeg.encode(docs)).collect()}
    assert set(got) == set(ALL) and got[2]["payload_bytes"] == 64 and got[2]["n_bytes"] == 0 and got[1]["media_sha256"] == got[6]["media_sha256"]
    assert all(r["bad_checksums"] == 0 for r in got.values())


def test_pages(spark):
    rows = [(1, "http://a.example/x", None, "h"), (2, None, "<p>one", "h"), (3, "::odd::", "<p>two</p>", "h"), (4, "http://a.example/y", "", "h"), (4, "http://a.example/y", "", "h"), (5, "http://a.example/z", "<" * 5000 + "<p " + "'" * 999, "h")]
    got = {r["page_id"]: r for r in html_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert got[1]["text"] == "" and got[2]["text"] == "one" and got[3]["text"] == "two" and got[4]["n_chars"] == 0 and 5 in got
    assert html_diff.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_empty_tables(spark, labels, benchmark):
    none = spark.createDataFrame([], SCHEMA)
    no_labels, no_items = labels.where("false"), benchmark.where("false")
    for out in (
        ngram_join.near_groups(none), ngram_join.one_of_each(none), rlz_dedup.remove_repeats(none), langid.identify(none), packing.pack(none), pii.surrogate(none), lm.score(none),
        decontam.report(none, benchmark), decontam.drop_contaminated(none, no_items), quality.score(none, labels), quality.keep_good(none, no_labels), mpeg.describe(mpeg.encode(none)),
    ):
        assert out.count() == 0


def test_nothing_to_learn_from(docs, labels, benchmark):
    assert {r["score"] for r in quality.score(docs, labels.where("false")).collect()} == {0.5}
    assert quality.keep_good(docs, labels.where("false")).count() == len(ROWS)
    assert not any(r["contaminated"] for r in decontam.report(docs, benchmark.where("false")).collect())

"""Every operator on odd rows, empty tables and clashing extra columns."""

import hashlib

import pytest

from faresight.llm import decontaminate, embeddings, html_extract, licenses, minhash, mixing, quality, token_counts, toxicity, warc
from tests.llm.conftest import odd_texts


def by_id(df, *cols):
    return sorted((tuple(r[c] for c in ("doc_id", *cols)) for r in df.collect()), key=repr)


def test_decontaminate(spark, odd_docs, no_docs):
    base = odd_texts()[0][1].split()
    items = spark.createDataFrame([(1, " ".join(base[20:35])), (2, "one"), (3, None), (4, "..."), (None, "two"),
                                   (5, "ONE"), (6, "nowhere to be found")], "item_id long, text string")
    found = decontaminate.find_leaks(odd_docs, items)
    assert found.columns[:len(odd_docs.columns)] == odd_docs.columns        # input columns as they were
    assert {r["n_words"] for r in found.collect()} == {7}
    got = {(r["doc_id"], r["_n_words"], r["n_hit"], tuple(r["_items"]), r["contaminated"]) for r in found.collect()}
    assert (0, 120, 15, ("1",), True) in got and (1, 120, 15, ("1",), True) in got
    assert (7, 1, 1, ("2", "5"), True) in got and (8, 1, 1, ("2", "5"), True) in got
    assert (3, 0, 0, (), False) in got and (4, 0, 0, (), False) in got and (9, 2, 0, (), False) in got
    assert found.count() == odd_docs.count()
    assert decontaminate.find_leaks(no_docs, items).count() == 0
    none = decontaminate.find_leaks(odd_docs, items.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == odd_docs.count()
    assert decontaminate.decontaminate(odd_docs, items).columns == odd_docs.columns


def test_mixing(odd_docs, no_docs):
    rows = mixing.assign(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["doc_id"]: r["size"] for r in rows if r["doc_id"] is not None}[3] == 0
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
        assert own[0]["source_size"] == sum(r["size"] for r in own)
    assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    assert mixing.assign(no_docs).count() == 0
    assert mixing.by_first_position(mixing.assign(odd_docs)).count() == len(rows)


def test_near_duplicates(odd_docs, no_docs):
    got = by_id(minhash.near_duplicates(odd_docs), "n_shingles", "component_id", "kept")
    assert len(got) == odd_docs.count()
    assert (0, 116, 0, True) in got and got.count((1, 116, 0, False)) == 2 and (2, 116, 0, False) in got
    assert (3, 0, 3, True) in got and (5, 0, 5, True) in got and (7, 1, 7, True) in got and (8, 1, 7, False) in got
    assert (None, 116, None, True) in got and (None, 0, None, True) in got
    kept = minhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14] and ids.count(None) == 2
    assert minhash.near_duplicates(no_docs).count() == 0 and minhash.drop_near_duplicates(no_docs).count() == 0


def test_same_id_with_two_texts(spark):
    a, b = "a b c d e f", "g h i j k l"
    docs = spark.createDataFrame([(5, a), (5, b), (7, a), (8, b), (9, "z")], "doc_id long, text string")
    assert by_id(minhash.near_duplicates(docs), "component_id") == [(5, 5), (5, 5), (7, 5), (8, 5), (9, 9)]
    kept = minhash.drop_near_duplicates(docs.unionByName(docs)).collect()
    assert sorted(r["doc_id"] for r in kept) == [5, 9]


@pytest.mark.parametrize("module, drop", [(toxicity, "drop_toxic"), (quality, "drop_poor")])
def test_classifiers(odd_docs, no_docs, labels, no_labels, module, drop):
    for lab in (labels, no_labels):
        scored = module.score(odd_docs, module.fit(odd_docs, lab)).collect()
        assert len(scored) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in scored)
        kept = getattr(module, drop)(odd_docs, lab)
        assert kept.columns == odd_docs.columns and kept.count() <= odd_docs.count()
        assert module.score(no_docs, module.fit(no_docs, lab)).count() == 0
        assert getattr(module, drop)(no_docs, lab).count() == 0


def test_token_counts(odd_docs, no_docs):
    v = token_counts.load_vocabulary()
    got = by_id(token_counts.count_tokens(odd_docs, v), "n_pretokens", "n_tokens")
    assert len(got) == odd_docs.count()
    assert (3, 0, 0) in got and (4, 0, 0) in got and (5, 0, 0) in got
    assert [p for i, p, _ in got if i == 11] == [1] and all(t >= p for _, p, t in got)
    assert token_counts.count_tokens(no_docs, v).count() == 0


def test_licenses(odd_docs, no_docs):
    from pyspark.sql import functions as F
    found = licenses.scan(odd_docs)
    assert found.count() == odd_docs.count() and found.columns[:len(odd_docs.columns)] == odd_docs.columns
    assert {(r["doc_id"], r["own_license"], r["first_line"]) for r in found.collect() if r["own_license"]} == {(12, "MIT", True)}
    placed = found.withColumn("path", F.when(F.col("doc_id") != 9, F.concat_ws("/", "source", F.col("doc_id").cast("string"))))
    got = {(r["doc_id"], r["license"], r["license_dir"]) for r in licenses.inherit(
        placed, "path", "own_license", "license_score", F.col("first_line")).collect()}
    assert (12, "MIT", None) in got and (7, "MIT", "d") in got and (9, None, None) in got and (3, None, None) in got
    assert licenses.scan(no_docs).count() == 0


def test_nearest_ancestor(spark):
    from pyspark.sql import functions as F
    rows = [("a/LICENSE", "MIT", 0.9), ("a/b/c/x", None, None), ("a/b/LICENSE", "GPL-3.0", 0.7), ("a/b/LICENSE2", "MIT", 0.9),
            ("a/bb/y", None, None), ("q/z", None, None), ("top", None, None), (None, None, None), ("a/b/own", "CC0-1.0", 0.8)]
    df = spark.createDataFrame(rows, "path string, own string, score double")
    got = {(r["path"], r["license"], r["license_dir"]) for r in licenses.inherit(
        df, "path", "own", "score", F.col("path").contains("LICENSE")).collect()}
    assert ("a/b/c/x", "MIT", "a/b") in got and ("a/bb/y", "MIT", "a") in got and ("q/z", None, None) in got
    assert ("a/b/own", "CC0-1.0", None) in got and (None, None, None) in got and ("top", None, None) in got


PAGES = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "", ""), (5, "bad\r\nurl \x01", "é" * 3),
         (None, "n", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (6, "long", "<p>" + "word " * 60_000 + "</p>"), (7, "u", "<<<>><p")]


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(*r, 1, "x", "y") for r in PAGES],
                                  "page_id long, url string, html string, key int, payload string, hash string")
    warc.write_archive(pages, str(tmp_path / "w"))
    rows = warc.read_archive(spark, str(tmp_path / "w")).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows), key=repr)
    assert got == sorted([(1, 8, "revisit", 2), (2, 8, "response", None), (2, 8, "response", None), (3, 0, "revisit", 4),
                          (4, 0, "response", None), (5, 6, "response", None), (None, 8, "revisit", 2),
                          (6, 300_007, "response", None), (7, 7, "response", None)], key=repr)
    assert all(r["intact"] for r in rows)
    assert {r["payload_digest"] for r in rows if r["payload_bytes"] == 0} == {warc.payload_digest(b"")}
    warc.write_archive(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(*r, "x", 1) for r in PAGES], "page_id long, url string, html string, text string, n_chars int")
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(
        pages, html_extract.learn_weights(pages)).collect() if r["page_id"] != 6}
    assert got == {(1, "x", 1), (2, "x", 1), (3, "", 0), (4, "", 0), (5, "ééé", 3), (None, "x", 1), (7, "<<<>>", 5)}
    assert html_extract.extract(pages.limit(0), html_extract.learn_weights(pages.limit(0))).count() == 0


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]),
            (6, [1.0, None]), (7, []), (8, [1.0, 0.1]), (9, [0.0, 1.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]),
            (11, [1e30, 1e29]), (12, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "u") for r in rows], "vec_id long, embedding array<float>, rep int, unit string")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"])
                  for r in embeddings.near_duplicate_vectors(df).collect()), key=repr)
    assert got == sorted([(0, 4, 0, True), (1, 4, 0, False), (1, 4, 0, False), (8, 4, 0, False), (11, 4, 0, False),
                          *((i, 0, i, True) for i in (2, 3, 4, 5, 6, 7, 9, 10, 12)), (None, 0, None, True)], key=repr)
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")

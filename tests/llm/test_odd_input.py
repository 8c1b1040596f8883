"""Odd input of the training-data operators and of the pipeline's stages: nulls, repeated rows, clashing columns, long texts, foreign vocabularies."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F

import corpus_pipeline
from pulselake.llm import jaccard, languages, leaks, lines, token_files, tokens, toxicity, urls

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def words(r, n, bad=0.0):
    return " ".join(r.choice(["vile", "nasty", "awful"]) if r.random() < bad else "".join(r.choice("aeioulmnrst") for _ in range(5)) for _ in range(n))


def test_ordinal_follows_its_gradient():
    """The fitted cumulative-link model is at a minimum: numeric derivatives of its loss vanish there, and thresholds share weights."""
    r = np.random.default_rng(1)
    n = 400
    x = r.normal(size=(n, 2))
    y = np.searchsorted([-0.7, 0.4, 1.2], 1.5 * x[:, 0] - 0.8 * x[:, 1] + r.logistic(size=n) * 0.5)
    row, column = np.repeat(np.arange(n), 2), np.tile(np.arange(2), n)
    w, cuts = toxicity.ordinal(row, column, x.ravel(), 2, y, 4, rounds=3000)

    def loss(theta):
        z = x @ theta[:2]
        p = 1 / (1 + np.exp(-(z[:, None] - theta[2:])))
        above = y[:, None] > np.arange(3)
        return -(np.log(np.where(above, p, 1 - p)).sum(1)).mean() + 0.5e-4 * (theta[:2] ** 2).sum()

    theta = np.concatenate((w, cuts))
    steps = [(loss(theta + 1e-5 * np.eye(5)[i]) - loss(theta - 1e-5 * np.eye(5)[i])) / 2e-5 for i in range(5)]
    assert np.abs(steps).max() < 2e-3 and (np.diff(cuts) > 0).all() and w[0] > 0 > w[1]


def test_toxicity_takes_one_row_an_id(spark):
    r = random.Random(4)
    rows = [(i, words(r, 40, 0.3 * (i % 2))) for i in range(60)]
    docs = spark.createDataFrame([*rows, *[(3, "again " + words(r, 5))] * 500, (None, "vile"), (99, None)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("toxic", "severity", "n", "h")})
    labels = spark.createDataFrame([*((i, i % 2) for i in range(60)), (None, 1), (5, None), (3, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, most=50)
    assert [model.features.tolist(), model.weights.tolist(), model.cuts.tolist()] == [x.tolist() for x in (lambda m: (m.features, m.weights, m.cuts))(toxicity.fit(docs.repartition(7), labels, most=50))]
    got = toxicity.score(docs, model).collect()
    assert len(got) == 562 and all(x.severity is not None for x in got)
    assert len({x.severity for x in got if x.doc_id == 3 and x.text.startswith("again")}) == 1
    long = spark.createDataFrame([(1, "word " * 400_000 + "vile " * 200_000), (2, "x" * 2_000_000), (3, "")], "doc_id long, text string")
    assert toxicity.score(long, model).count() == 3 and toxicity.clean(long, model).columns == ["doc_id", "text"]


def test_foreign_vocabularies_are_refused(spark):
    folder = os.path.dirname(PATH)
    assert tokens.checked(PATH) == PATH
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for call in (lambda p: tokens.encode(docs, p), lambda p: tokens.decode(docs.withColumn("ids", F.lit(None).cast("binary")), p), lambda p: token_files.write(docs, p, 2)):
        with pytest.raises(ValueError):
            call(os.path.join(folder, "byte_bpe_50k.json"))


def test_token_files_of_repeated_ids_and_ranges_of_bytes(spark, tmp_path):
    docs = spark.createDataFrame([(i % 7, words(random.Random(i), i % 30)) for i in range(50)] + [(None, "x"), (3, None)], "doc_id long, text string").withColumn("start", F.lit(1))
    got = token_files.read(spark, token_files.write(docs, PATH, 2, shards=3), with_ids=True, docs_at_once=4).orderBy("start").collect()
    assert len(got) == 52 and [x.start for x in got] == np.cumsum([0, *(x.n_tokens for x in got)])[:-1].tolist()
    assert all(x.ids_crc32 == zlib.crc32(bytes(x.ids)) and len(x.ids) == 4 * x.n_tokens for x in got)
    (tmp_path / "n").write_bytes(np.arange(100, dtype="<u4").tobytes())
    far = pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem())  # read as a file system that can't be mapped
    for first, count in ((0, 100), (7, 5), (99, 1), (50, 0)):
        assert token_files.opened(far, "n", "<u4", first, count).tolist() == token_files.opened(pafs.LocalFileSystem(), str(tmp_path / "n"), "<u4", first, count).tolist() == list(range(first, first + count))


def test_lines_of_rows_without_id_and_rows_that_repeat(spark):
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(200_000))
    rows = [(None, "first line of all\nsecond"), (2, "first line of all\nthird line here"), (2, "first line of all\nthird line here"), (3, f"{long}\nx"), (4, f"{long[:-1]}Q\ny"), (5, None), (None, None)]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("n_lines", "line", "id", "version", "label")})).collect()
    texts = sorted(((x.doc_id, x.text) for x in got), key=str)
    assert len(got) == 7 and texts.count((2, "first line of all\nthird line here")) == 2  # rows that repeat are treated alike
    assert (None, "second") in texts  # a null id comes last, so the line stays with document 2
    assert (4, "y") in texts and {x.n_dropped for x in got if x.doc_id == 3} == {0}


def test_languages_of_rows_without_id_and_rows_that_repeat(spark):
    rows = [(i, "the quick brown fox" if i % 2 else "der schnelle braune fuchs", "en" if i % 2 else "de") for i in range(40)] + [(None, "the fox", "en"), (None, None, None), (1, "the quick brown fox", "en"), (7, "12 34", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1))
    got = languages.identify(docs, languages.train(docs, F.lit(True))).collect()
    assert len(got) == 44 and {x.lang_pred for x in got if x.doc_id == 7} == {"en", "und"} and all(0 <= x.score <= 1 for x in got)
    assert sorted(str(x.lang_pred) for x in got if x.doc_id is None) == ["en", "und"]


def test_leaks_of_rows_and_items_without_id(spark):
    item = words(random.Random(3), 30)
    docs = spark.createDataFrame([(None, "a b " + item), (1, item + " c"), (1, item + " c"), (2, "nothing here at all to find"), (3, None)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("item_id", "similarity", "place")})
    items = spark.createDataFrame([(None, item), (7, item), (8, None), (9, "")], "item_id long, text string")
    found = leaks.leaks(docs, items)
    assert {(x.doc_id, x.item_id) for x in found.collect()} >= {(1, 7)}
    kept = leaks.decontaminate(docs, items).collect()
    assert sorted(str(x.doc_id) for x in kept if x.doc_id) == ["2", "3"]


def test_jaccard_and_urls_of_rows_without_id(spark):
    text = words(random.Random(5), 50)
    docs = spark.createDataFrame([(None, text), (4, text), (2, text + " x"), (4, text)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("component_id", "node", "n_shingles")})
    assert sorted((x.doc_id, x.component_id) for x in jaccard.join(docs).collect()) == [(2, 2), (4, 2), (4, 2)]
    assert sorted(str(x.doc_id) for x in jaccard.representatives(docs).collect()) == ["2", "None"]
    pages = spark.createDataFrame([(None, "http://a.org/es/x"), (1, "http://a.org"), (2, None), (None, "no url")], "page_id long, url string").withColumns({c: F.lit("x") for c in ("rule", "listed", "host", "path", "verdict")})
    got = {(x.page_id, x.host, x.path): (x.rule, x.verdict) for x in urls.judge(pages).collect()}
    assert got == {(None, "a.org", "/es/x"): ("org/es/", "block"), (1, "a.org", ""): (None, "allow"), (2, "", ""): (None, "allow"), (None, "", ""): (None, "allow")}


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_stages_of_the_pipeline(spark, kind):
    """Each stage keeps the columns, what else documents have too, and clean rows."""
    r = random.Random(8)
    rows = [(i, words(r, 60), "en", "web", 0) for i in range(12)] + [(3, None, None, None, None), (None, words(r, 60), "de", "web", 1), (5, "", "en", "", 0), (40, words(r, 30_000), "en", "web", 9)]
    docs = spark.createDataFrame(rows if kind == "odd" else [], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("node", "label", "rank", "toxic_", "bucket")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
        left = out.collect()
        assert len(left) == (len(rows) if kind == "odd" else 0), name  # nothing here is toxic, repeated or leaked
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and {"doc_id", "n_tokens"} <= set(last.columns)


def test_fingerprints_split_one_document_id(spark):
    """Half of the rows have one doc_id: its texts are spread over tasks, and what comes out doesn't depend on the ranges."""
    from pyspark.sql import functions as G

    from pulselake.llm import fingerprints

    rows = [(7 if i % 2 else i, words(random.Random(i), 3 + i % 20)) for i in range(400)] + [(None, "a b"), (None, None), (7, words(random.Random(1), 4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [sorted(map(tuple, fingerprints.compare_with_edited(docs, buckets=n).collect()), key=str) for n in (1, 4, 16)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 403
    plan = fingerprints.compare_with_edited(docs, buckets=4)
    sizes = [r["count"] for r in plan.groupBy(G.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 200  # doc_id 7 alone has 201 rows


def test_digest_arrays_of_a_million_entries(tmp_path):
    entries = [f"host{i}.example.org/{i % 97}" for i in range(1_000_000)]
    urls.DigestArray.save(entries, str(tmp_path / "d"))
    found = urls.DigestArray(str(tmp_path / "d"))
    r = random.Random(1)
    asked = [r.choice(entries) for _ in range(5_000)] + [f"other{i}.example.org/{i}" for i in range(5_000)]
    assert found.n == 1_000_000 and found.has(asked).tolist() == [True] * 5_000 + [False] * 5_000


def test_equal_digests_are_told_apart_by_their_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda raw: len(raw) % 3)  # nearly everything collides
    urls.DigestArray.save(["aaa", "bbb", "cc", "dddd", "eeeeee"], str(tmp_path / "d"))
    found = urls.DigestArray(str(tmp_path / "d"))
    assert found.has(["aaa", "bbb", "ccc", "cc", "dddd", "dddx", "eeeeee", "ffffff", ""]).tolist() == [True, True, False, True, True, False, True, False, False]


def test_both_ways_of_matching_a_table_of_entries(spark):
    r = random.Random(2)
    entries = spark.range(30_000).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, "/p").when(F.col("id") % 3 == 1, "/p/q").otherwise("")).alias("entry"))
    rows = [(f"{a}h{i}", r.choice(["", "/p", "/p/q/r", "/x"])) for i, a in ((r.randint(0, 40_000), r.choice(["", "www.", "a.b."])) for _ in range(500))]
    sides = spark.createDataFrame(rows, "host string, path string")
    sent, joined = (sorted(map(tuple, urls.matched(sides, entries, "found", most).collect()), key=str) for most in (1 << 30, 0))
    assert sent == joined and any(x[2] for x in sent) and not all(x[2] for x in sent)

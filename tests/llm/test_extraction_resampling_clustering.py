"""Main text, importance resampling and centroid clustering against brute force, with every odd case."""

import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulselake.llm import centroids, common, extraction, queries, resample

SF = "/root/testdata/sf0.001"


# main text


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    new = [0]
    for j, y in enumerate(b):
        new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
    return new


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=30), st.lists(st.integers(0, 6), max_size=30))
def test_common_is_a_longest_common_subsequence(a, b):
    x, y = extraction.common(a, b)
    assert x == sorted(set(x)) and y == sorted(set(y)) and [a[i] for i in x] == [b[j] for j in y]
    assert len(x) == lcs_length(a, b)


def test_common_of_long_lists_of_one_value():
    x, y = extraction.common([1] * 3000 + [2], [2] + [1] * 2000)
    assert len(x) == len(y) == 2000


def kept(page):
    found, kinds = extraction.page_blocks(page)
    return [t for t, k in zip(found, kinds, strict=True) if k != extraction.NAMED]


@pytest.mark.parametrize(
    "page, want",
    [
        (None, []),
        ("", []),
        ("just text &amp; more\n\n text", ["just text & more text"]),
        ("<p>a<p>b<div>c</p>d", ["a", "b", "c", "d"]),
        ("<article><h1>T&eacute;</h1><p><b>x.<br><p>y&nbsp;z</p></article>", ["Té", "x.", "y z"]),
        ("<nav>menu<article>m</article></nav><main>text<aside>s</aside><footer>f</footer><form>g</form></main>after", ["text", "after"]),
        ("<article><header><h1>T</h1></header>t<div class='reader-comments'><p>c</p></div>u</article><header>site</header>", ["T", "t", "u"]),
        ("<article>a <span class=ad>buy</span> b</article>", ["a", "b"]),
        ("<div class='no-sidebar'>x</div><div class='left sidebar'>y</div><div id=cookie-notice>z</div><p hidden>w</p><div role=navigation>v</div>", ["x"]),
        ('<script>var t="</p>";</script>a<style>p{}</style><!-- b -- > c -->d<!--> e', ["ad e"]),
        ("<script>never closed <p>a", []),
        ('<a title="x > y" href=\'>\'>l</a><p title="unclosed>z</p>', ["l", "z"]),
        ("a < b &am &amp &lt;p&gt;", ["a < b &am & <p>"]),
        ("<p>a</p><p title='cut", ["a"]),
        ("<p>a <!-- cut", ["a"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f</table><dl><dt>g<dd>h</dl>", ["a", "b", "c", "d", "e", "f", "g", "h"]),
        ("</div></p>a</b>b<P>C</P>", ["ab", "C"]),
    ],
)
def test_blocks_of_pages(page, want):
    assert kept(page) == want


def test_deep_and_long_pages_take_linear_time():
    n = 30_000
    assert kept("<div>" * n + "x" + "</span>" * n) == ["x"]
    assert kept("<b>" * n + "x" + "<p>" * n) == ["x"]
    assert len(kept("<p>y" * n)) == n


def page(*blocks, menu="Home"):
    return "<body>" + "".join(f"<div>{b}</div>" for b in (menu, *blocks, "Imprint")) + "</body>"


def test_shared_blocks_go_and_articles_stay(spark):
    rows = [
        (1, "http://A.org/x/1", page("one", "Share this", "uno")),
        (2, "http://a.org/x/2?q", page("two", "Share this")),
        (3, "http://a.org/y", page("three", menu="Start")),
        (4, "http://b.org/x/1", page("one")),
        (5, "http://c.org/1", "<nav>m</nav><article><p>passage</p><p>own</p></article>"),
        (6, "http://c.org/2", "<nav>m</nav><article><p>passage</p><p>other</p></article>"),
        (7, "http://d.org/", page("copy")),
        (8, "http://d.org/", page("copy")),
        (9, None, "nowhere"),
        (None, "no host", None),
        (None, None, "<p>  </p>"),
    ]
    df = spark.createDataFrame([*rows, rows[6], rows[9]], "page_id long, url string, html string")
    for c in ("host", "path", "range", "ghost", "blob", "h", "text", "n_chars"):
        df = df.withColumn(c, F.lit(1))
    want = {1: "one\nuno", 2: "two", 3: "Start\nthree", 4: "Home\none\nImprint", 5: "passage\nown", 6: "passage\nother", 7: "Home\ncopy\nImprint", 8: "Home\ncopy\nImprint", 9: "nowhere", None: ""}
    for n in (1, 3, 50):
        got = extraction.main_text(df.repartition(3), n).collect()
        assert len(got) == 13
        for r in got:
            assert r.text == want[r.page_id] and r.n_chars == len(r.text), (n, r)
        assert {(r.page_id, r.url) for r in got} == {(r[0], r[1]) for r in rows}
    assert extraction.main_text(df.limit(0)).count() == 0


def test_ranges_do_not_change_the_text(spark):
    r = random.Random(3)
    rows = [(i, f"http://{'hot' if i % 3 else 'h' + str(i % 7)}.org/{r.randint(0, 40)}/{i}", page(*(r.choice("abcdefgh") + str(r.randint(0, 3)) for _ in range(r.randint(0, 9))), menu=r.choice("xy"))) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [sorted(map(tuple, extraction.main_text(df.repartition(p), n).collect())) for p, n in ((1, 1), (4, 7), (7, 64))]
    assert got[0] == got[1] == got[2]
    # the same by neighbours in one sorted list and a plain longest common subsequence
    order = sorted(rows, key=lambda x: (re.sub("^.*//|/.*", "", x[1]), "/" + x[1].split("/", 3)[3], x[1], x[0]))
    blocks = {i: kept(h) for i, _, h in rows}
    hosts = {i: re.sub("^.*//|/.*", "", u) for i, u, _ in rows}
    by_id = {x[0]: x for x in got[0]}
    shared = dict.fromkeys(blocks, 0)
    for a, b in zip(order, order[1:], strict=False):
        if hosts[a[0]] == hosts[b[0]] and blocks[a[0]] != blocks[b[0]]:
            for i in (a[0], b[0]):
                shared[i] = max(shared[i], lcs_length(blocks[a[0]], blocks[b[0]]))
    for i, _, text, _, n_shared, n_blocks in got[0]:
        assert n_blocks == len(blocks[i]) and shared[i] <= n_shared and len(text.split("\n") if text else []) == n_blocks - n_shared
        left = iter(blocks[i])
        assert all(t in left for t in by_id[i][2].split("\n") if t)


def test_main_text_of_the_given_pages(spark):
    got = {r.page_id: r for r in queries.QUERIES["op12_main_text"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:  # the template of these pages
        inside = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        cut = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside))
        assert got[r.page_id].text == "\n".join(b for b in cut if b) and got[r.page_id].url == r.url


# importance resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def resampled(docs, target, percent, least, buckets):
    def total(texts):
        n = [0] * buckets
        for t in texts:
            for f in features(t)[1]:
                n[zlib.crc32(f.encode()) % buckets] += 1
        return n

    s, t = total(x for _, x in docs), total(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, x in docs:
        n, f = features(x)
        weight = sum(gain[zlib.crc32(y.encode()) % buckets] for y in f)
        h = i is not None and int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    part = sorted((r for r in out if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(part[: percent * len(part) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def odd_documents():
    r = random.Random(5)
    words = ["The", "of", "and", "ÄÖ", "naïve", "x" * 63, "y" * 64, "Z" * 65, "w" * 500, "42", "日本語", "a-b", "c_d", "\u0085", "q r", "end."]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 80))) for _ in range(60)]
    return [*enumerate(texts), *enumerate(texts[:3]), (70, None), (71, ""), (72, " - "), (None, "The of " * 20), (None, None), (73, "one two " * 40_000), (74, "v" * 300_000 + " u " + "v" * 300_000)]


@pytest.mark.parametrize("percent, least, buckets", [(5, 20, 10_000), (50, 1, 97), (100, 0, 10_000)])
def test_resampling_equals_brute_force(spark, percent, least, buckets):
    docs, target = odd_documents(), ["The of the", "w" * 500 + " naïve", None, "one two one"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "row", "range", "place", "rank", "score", "bucket", "feature")})
    got = resample.resample(df.repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), percent, least, 42, buckets).collect()
    assert sorted(map(tuple, got), key=repr) == resampled(docs, target, percent, least, buckets)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, none).count() == 0
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: (r.n_features, r.rank) for r in resample.resample(some, none, 100, 1).collect()} == {1: (3, 1), 2: (0, None)}


def test_the_head_changes_nothing():
    column = pa.array([t for _, t in odd_documents()])
    parts = common.split_words(column, table=resample.WORDS)
    found = []
    for known in (resample.head([], []), resample.head(["the", "of", "x" * 63], ["the of", "of of", "not known"]), resample.head(parts[2].to_pylist(), ["of the", "the the"])):
        found.append([np.concatenate([x[2][k] for x in resample._features(*parts, known, 10_000)]) for k in range(3)])
    want = [[zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for w in map(lambda t: features(t)[1][: features(t)[0]], column.to_pylist()) for i in range(len(w) - k + 1)] for k in (1, 2, 3)]
    assert all(x.tolist() == y for f in found for x, y in zip(f, want, strict=True))


def test_the_query_for_resampling(spark):
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(*c).collect()]
    got = queries.QUERIES["op11_resampling"](spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == resampled(read("documents", "doc_id", "text"), [t for (t,) in read("benchmark", "text")], 5, 20, 10_000)


# centroids


def clustered(rows, k, rounds, dim):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(math.floor(1024 * x)) < 2**27 for x in v)]
    centres = [v for _, v in sorted(kept, key=lambda r: ("~" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = [[v for _, v in kept if assign(v)[1] == n] for n in range(len(centres))]
        centres = [[sum(x) // len(x) for x in zip(*o, strict=True)] if o else c for o, c in zip(own, centres, strict=True)]
    last = [(i, *assign(v)) for i, v in kept]
    return sorted(((i, n, d, sum(x[1] for x in last if x[2] == n), sum(x[1] for x in last), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, d, n in last), key=repr)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clustering_equals_brute_force(spark, kind):
    r = random.Random(9)
    rows = [(i, [float(np.float32(r.choice([-1, 0, 0.5, 1]) + r.random() * (i % 4))) for _ in range(3)]) for i in range(150)]
    rows += [(i, [0.5, 0.5, 0.5]) for i in range(200, 300)] + rows[:5]  # a third are one vector
    rows += [(400, None), (401, []), (402, [1.0, 2.0]), (403, [1.0, None, 2.0]), (404, [1.0, float("nan"), 2.0]), (405, [float("inf"), 1.0, 2.0]), (406, [131072.0, 0.0, 0.0]), (407, [131000.0, -131000.0, 0.0]), (None, [0.25, 0.0, -0.0])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({c: F.lit(1) for c in ("cluster", "distance", "ids", "h", "x", "label")})
    for k in (1, 5, 8, 12):
        got = centroids.cluster(df.repartition(4), k=k, rounds=4, dim=3).collect()
        assert sorted(map(tuple, got), key=repr) == clustered(rows, k, 4, 3)
    few = spark.createDataFrame(rows[:2], f"vec_id long, embedding array<{kind}>")
    assert sorted(map(tuple, centroids.cluster(few, dim=3).collect()), key=repr) == clustered(rows[:2], 8, 10, 3)
    assert centroids.cluster(few.limit(0)).count() == 0 and centroids.cluster(few).count() == 0


def test_the_tree_finds_the_nearest_and_prunes():
    r = np.random.default_rng(1)
    for k, dim in ((1, 2), (8, 64), (300, 4)):
        centres = r.integers(-1000, 1000, (k, dim))
        centres[k // 2 :: 7] = centres[0]  # equal centroids
        x = np.concatenate((r.integers(-1000, 1000, (500, dim)), centres))
        who, d, taken = centroids.nearest(centroids.build(centres), x)
        every = ((x[:, None] - centres[None]) ** 2).sum(2)
        assert (who == every.argmin(1)).all() and (d == every.min(1)).all()
        if k == 300:
            assert taken < 0.3 * every.size


def test_centroid_query_equals_sql(spark, tables):
    got = queries.QUERIES["op13_centroids"](spark, SF)
    want = tables.execute(queries.ORACLE_SQL["op13_centroids"])
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()) and [c[0] for c in want.description] == got.columns

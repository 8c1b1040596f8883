"""The training-data operators against brute force, on small documents with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulselake.llm import closing, common, fingerprints, graphs, jaccard, languages, leaks, lines, lm, token_files, tokens, toxicity, urls

PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile("[^\x20\x09-\x0d]+")
#: Names that the operators use themselves.
CLASHES = ["node", "bucket", "block", "h", "n", "ids", "key", "version", "rank", "label", "component_id", "n_lines", "severity", "fingerprint", "decoded"]


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def some_texts():
    r = random.Random(7)
    words = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "ré", "Ño") for b in ("la", "ne", "si", "Do", "x", "!")]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(25)]
    near = []
    for t in base:
        w = t.split(" ")
        if len(w) > 30:
            w[0] = "other"
            near.append(" ".join(w))
    long = " ".join(r.choice(words) for _ in range(3000))
    return [*base, *near, *base[:3], long, long + " end", "", None, "   \n\t ", "one", "two words", "a\nb\nc", "<|endoftext|>x <|startoftext|>", "x\u0085y z q ſ İ é"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i * 3, t) for i, t in enumerate(some_texts())]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")  # the first row twice
    path = str(tmp_path_factory.mktemp("docs") / "docs")
    df.withColumns({c: F.lit(1) for c in CLASHES}).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def by_id(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_words_of_slices():
    column = pa.array(["Áb C", None, "  x\x0by ", "", "É É"] * 5).slice(3, 11)
    counts, codes, words = common.split_words(column, lower=True)
    want = [WORD.findall(lowered(t)) for t in column.to_pylist()]
    assert counts.tolist() == [len(w) for w in want] and [words.to_pylist()[c] for c in codes] == [x for w in want for x in w]


def test_bpe_round_trip(spark, docs, by_id):
    library = Tokenizer.from_file(PATH)
    got = tokens.decode(tokens.encode(docs, PATH), PATH).collect()
    assert len(got) == docs.count()
    for r in got:
        want = library.encode(by_id[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert sorted(map(repr, tokens.encode(docs, PATH, decoded=True).collect())) == sorted(map(repr, got))
    assert tokens.encode(empty(spark), PATH).count() == 0
    odd = spark.createDataFrame([(None, np.array([0, 4_000_000, 5], "<u4").tobytes()), (1, None)], "doc_id long, ids binary")
    assert {r.doc_id: r.decoded for r in tokens.decode(odd, PATH).collect()} == {None: library.decode([0, 5], skip_special_tokens=False), 1: ""}


def test_token_files(spark, docs, by_id):
    library = Tokenizer.from_file(PATH)
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "no id")], "doc_id long, text string"))
    got = token_files.read(spark, token_files.write(more, PATH, end_id=2), with_ids=True).orderBy("start").collect()
    assert len(got) == more.count() and got[0].doc_id is None
    at = 0
    for r in got:
        want = library.encode((by_id[r.doc_id] if r.doc_id is not None else "no id") or "", add_special_tokens=False).ids + [2]
        raw = np.array(want, "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(want), zlib.crc32(raw), raw)
        at += len(want)
    assert [r.doc_id for r in got[1:]] == sorted(r.doc_id for r in got[1:])
    assert token_files.read(spark, token_files.write(empty(spark), PATH, end_id=2)).count() == 0


def shingle_set(t, lower=False):
    w = WORD.findall(lowered(t) if lower else t or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints(spark, docs, by_id):
    got = fingerprints.compare_with_edited(docs.dropDuplicates(["doc_id"])).collect()
    order = sorted(by_id, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    assert sorted(r.doc_id for r in got) == sorted(by_id)
    prints = {}
    for r in got:
        t = by_id[r.doc_id] or ""
        n = len(t) // 2
        edited = t[: len(t) - n] + (by_id[after[r.doc_id]] or "")[:n]
        assert (r.edited_text, r.n_chars) == (edited, len(t))
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        a, b = shingle_set(t), shingle_set(edited)
        if len(a | b) > 1000:
            assert abs(r.near_edited - len(a & b) / len(a | b)) < 0.08
        if t == edited:
            assert r.near_edited == 1.0
        assert abs(r.near_next - fingerprints.likeness(*fingerprints.sketches(pa.array([t, by_id[after[r.doc_id]] or ""])))) < 1e-12
    assert fingerprints.compare_with_edited(empty(spark)).count() == 0
    odd = spark.createDataFrame([(1, "a b c"), (1, "a b d"), (1, "a b c"), (None, "x y"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_chars) for r in fingerprints.compare_with_edited(odd).collect()) == [(0, 0), (0, 3), (1, 5), (1, 5), (1, 5)]
    assert fingerprints.compare_with_edited(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first().edited_text == "abcabc"  # its own next


def test_sketches_merge_and_contain():
    long, part = " ".join(f"w{i}" for i in range(4000)), " ".join(f"w{i}" for i in range(1000, 1400))
    a, b = fingerprints.sketches(pa.array([long, part]))
    assert fingerprints.containment(b, a) > 0.97 and fingerprints.likeness(a, b) < 0.2
    assert np.array_equal(fingerprints.from_text(fingerprints.as_text(a)), a)
    assert [len(s) for s in fingerprints.sketches(pa.array(["", None, "a"]))] == [0, 0, 1] and fingerprints.likeness(a[:0], a[:0]) == 1.0


@pytest.mark.parametrize("scale", [1, 4, 8, 50])
def test_merged_sketches_equal_the_sketch_of_both(scale):
    """Brute force over sets of shingles: which hashes are kept, merging, containment of short parts."""
    r = random.Random(scale)
    for _ in range(200):
        words = [[f"w{r.randrange(10**6)}" for _ in range(r.choice((1, 3, 6, 12, 60)))] for _ in range(2)]
        hashes = [np.unique(common.shingle_hashes(np.array([len(w)]), common.hash_strings(pa.array(w)))[0]) for w in words]
        sketch = lambda h: h[h < 2**64 // scale] if scale > 1 and (h < 2**64 // scale).any() else h if scale == 1 else h[:1]  # noqa: B023, E731
        got = fingerprints.sketches(pa.array([" ".join(w) for w in words]), scale)
        assert all(np.array_equal(x, sketch(h)) for x, h in zip(got, hashes, strict=True))
        assert np.array_equal(fingerprints.merged(*got, scale), sketch(np.union1d(*hashes)))
        part, whole = fingerprints.sketches(pa.array([" ".join(words[0][:6]), " ".join(words[0])]), scale)
        assert fingerprints.containment(part, whole, scale) in ((1.0, None) if len(words[0]) > 5 else (1.0,))
        assert fingerprints.likeness(part, part, scale) == 1.0


def joined_by_force(by_id):
    sets = {k: shingle_set(t, lower=True) for k, t in by_id.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_jaccard_join(spark, docs, by_id):
    got = jaccard.join(docs).collect()
    want = joined_by_force(by_id)
    assert len(got) == docs.count() and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert jaccard.join(empty(spark)).count() == 0
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, (_, c) in want.items() if c == k}


def test_jaccard_join_of_large_groups(spark, monkeypatch):
    """A chain of near copies, a passage that many share, exact copies: groups beyond FEW, closed in chunks."""
    r = random.Random(3)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(120)]
    texts = []
    for i in range(60):  # each differs from the next by one word more, far ends aren't similar
        texts.append(" ".join(base[i // 2 :] + [f"t{j}" for j in range(i // 2)]))
    texts += [" ".join(base[:60] + [f"u{i}_{j}" for j in range(40)]) for i in range(40)]
    texts += [texts[0]] * 20
    rows = dict(enumerate(texts))
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    monkeypatch.setattr(closing, "CHUNK", 7)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()} == joined_by_force(rows)


def test_closing_is_linear(spark, monkeypatch):
    """1,000 members of one group, of which each is linked with its neighbours only: a forest, not all pairs, and no link lost."""
    monkeypatch.setattr(closing, "CHUNK", 300)
    n = 1000
    members = spark.createDataFrame([(1, i) for i in range(n)], "key long, node long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "node long, component long").where("node < 600")
    payload = members.select("node", F.lit(8).alias("size"))

    def judge(table):
        node = table["node"].to_numpy()
        return lambda x, ys: np.abs(node[ys] - node[x]) <= 50, lambda xs, ys: np.abs(node[ys] - node[xs]) <= 20

    links = closing.closing_links(members, labels, payload, judge, sided=False)
    rows = [tuple(r) for r in links.collect()]
    assert all(0 < b - a <= 20 for a, b in rows) and len(rows) < 3 * n  # all pairs within 20 would be 20 n
    every = links.union(labels.toDF("a", "b"))
    assert {r.component for r in graphs.components(every).collect()} == {0}


def test_forest_connects_what_all_pairs_connect(monkeypatch):
    """However few pairs are verified at once; with sides apart, or both the same rows."""
    r = np.random.default_rng(3)
    for pairs in (1, 7, 4096):
        monkeypatch.setattr(closing, "PAIRS", pairs)
        for ordered in (False, True):
            n = 60
            node, label, near = r.permutation(n), r.integers(0, 40, n), r.random((n, n)) < 0.02
            near |= near.T
            left = np.arange(n) if ordered else np.arange(n // 2)
            right = np.arange(n) if ordered else np.arange(n // 2, n)
            got = closing.forest(node, label, left, right, lambda x, ys: np.ones(len(ys), bool), lambda xs, ys, near=near: near[xs, ys], ordered)
            at = np.argsort(node)
            assert all(near[at[a], at[b]] and a < b for a, b in got) and len(got) < len(np.unique(label))
            every = [(x, y) for x in left for y in right if near[x, y] and x != y]
            assert parts(label, [(at[a], at[b]) for a, b in got]) == parts(label, every)
    none = np.zeros(0, np.int64)
    assert closing.forest(none, none, none, none, None, None).shape == (0, 2)


def parts(label, links):
    root = label.copy()
    for x, y in links:
        root[root == root[y]] = root[x]
    return {frozenset(np.flatnonzero(root == v).tolist()) for v in root}


def test_hot_join_does_not_run_left_to_count_it(spark):
    def fails(batches):
        raise RuntimeError("left was run")

    counted = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 0)], "k long, x long")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k long, y string")
    common.hot_join(counted.mapInArrow(fails, counted.schema), right, "k", least=10, counted=counted)  # only planned
    assert sorted(map(tuple, common.hot_join(counted, right, "k", least=10, counted=counted).collect())) == sorted(map(tuple, counted.join(right, "k").collect()))


def test_hot_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(i, i) for i in range(30)] + [(None, 1)], "k long, x long")
    right = spark.createDataFrame([(i, -i) for i in range(20)], "k long, y long")
    assert sorted(map(tuple, common.hot_join(left, right, "k", least=10).select("k", "x", "y").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "x", "y").collect()))


def test_jaccard_join_of_a_doc_id_with_several_texts(spark):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = [(5, t) for t in texts] + [(7 + i, f"{t} end") for i, t in enumerate(texts)] + [(12, "another text that is near to none"), (5, texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, r.component_id) for r in jaccard.join(df).collect()) == [(5, 5)] * 4 + [(7, 5), (8, 5), (9, 5), (12, 12)]
    assert sorted(r.doc_id for r in jaccard.representatives(df).collect()) == [5, 5, 5, 5, 12]


def test_block_keys_meet():
    """Sets within the bound share a key, whatever their sizes."""
    r = np.random.default_rng(5)
    for n in (5, 6, 9, 20, 45, 100, 333, 1000):
        for _ in range(20):
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            drop = r.integers(0, len(a) // 5 + 1)
            b = np.sort(a[drop:])
            keys, count = jaccard.block_keys(np.concatenate((a, b)), np.array([len(a), len(b)]))
            if 100 * len(b) >= 80 * len(a) and not np.array_equal(a, b):
                assert set(keys[: count[0]]) & set(keys[count[0] :])


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(30)] + [(5, 5), (None, 3)]
    root = {x: x for e in edges for x in e if None not in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[x] == find(x) for x in got) and set(got) >= {x for x in root if find(x) != x}


def lines_by_force(by_id, edits=2, every=12):
    places = defaultdict(list)
    for k in sorted(by_id, key=lambda k: (k is None, k)):
        for p, line in enumerate((by_id[k] or "").split("\n")):
            if line.strip():
                places[line].append((k, p))
    distinct = list(places)
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            may = min(edits, min(len(a), len(b)) // every)
            if may and abs(len(a) - len(b)) <= may and lines._short(a, b) <= may:
                root[find(a)] = find(b)
    first = {}
    for x in distinct:
        first[find(x)] = min(first.get(find(x), places[x][0]), places[x][0])
    return {k: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip() or first[find(x)] == (k, p)) for k, t in by_id.items()}


def test_line_dedup(spark, monkeypatch):
    r = random.Random(4)
    line = lambda: "".join(r.choice("abcdé ") for _ in range(r.randint(9, 60)))
    pool = [line() for _ in range(30)] + ["", "  ", "Short.", "Short!"]
    rows = {}
    for i in range(60):
        got = []
        for _ in range(r.randint(0, 6)):
            x = list(r.choice(pool))
            for _ in range(r.choice((0, 0, 0, 1, 2, 3))):
                if x:
                    x[r.randrange(len(x))] = r.choice("xyz")
            got.append("".join(x))
        rows[i] = "\n".join(got)
    rows[60], rows[61], rows[62] = None, "", rows[1]
    df = spark.createDataFrame([(k, t, 1, 1, 1) for k, t in rows.items()], "doc_id long, text string, line int, place int, n_lines int").repartition(4)
    got = lines.dedup(df)
    assert {r.doc_id: r.text for r in got.collect()} == lines_by_force(rows) and got.columns == ["doc_id", "text", "line", "place", "n_lines", "n_dropped"]
    monkeypatch.setattr(lines, "FEW", 1)  # all groups are closed in chunks
    monkeypatch.setattr(closing, "CHUNK", 3)
    assert {r.doc_id: r.text for r in lines.dedup(df).collect()} == lines_by_force(rows)
    assert lines.dedup(empty(spark)).count() == 0


def test_edit_distance():
    r = random.Random(9)
    pairs = []
    for _ in range(400):
        a = "".join(r.choice("abé") for _ in range(r.choice((0, 1, 4, 9, 30, 80))))
        b = list(a)
        for _ in range(r.randint(0, 4)):
            p = r.randint(0, len(b))
            b[p : p + r.randint(0, 1)] = r.choice(("", "a", "c"))
        pairs.append((a, "".join(b)))
    for edits in (1, 2, 4):
        assert lines.within(pairs, edits).tolist() == [lines._short(a, b) <= edits for a, b in pairs]


def test_letters_and_pairs_rule_out_no_near_line():
    r = random.Random(11)
    text = []
    for _ in range(40):
        a = "".join(r.choice("abcé ") for _ in range(r.choice((12, 20, 30, 60))))
        b = list(a)
        for _ in range(r.randint(0, 3)):
            p = r.randint(0, len(b))
            b[p : p + r.randint(0, 1)] = r.choice(("", "x", "é"))
        text += [a, "".join(b)]
    possible, linked = lines._judge(2, 12)(pa.table({"text": text}))
    every = np.arange(len(text))
    for x in every:
        ok = linked(np.full(len(every), x), every)
        assert ok[x] and not (ok & ~possible(x, every)).any()


def test_urls(spark):
    rows = [(1, "http://A.example.com/en/71?x"), (2, "https://b.example.net/de/8#t"), (3, "https://x.net/de/9"), (4, "ftp://q.org?en"), (5, None), (6, "no host"), (7, "http://www.spam-farm.example.com"), (8, "http://com/en/"), (9, "http://xcom/en/"), (1, "http://A.example.com/en/71?x")]
    df = spark.createDataFrame([(*x, "h", "v") for x in rows], "page_id long, url string, host string, verdict string")
    want = {1: ("a.example.com", "/en/71", "example.com/en/7", "allow"), 2: ("b.example.net", "/de/8", "example.net/de/8", "block"), 3: ("x.net", "/de/9", "net/de/", "allow"), 4: ("q.org", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"),
            7: ("www.spam-farm.example.com", "", None, "block"), 8: ("com", "/en/", "com/en/", "block"), 9: ("xcom", "/en/", None, "allow")}
    got = urls.judge(df).collect()
    assert len(got) == 10 and {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == want
    sides = spark.createDataFrame([(r.page_id, r.host, r.path) for r in got], "page_id long, host string, path string")
    listed = spark.createDataFrame([("com/en/",), ("example.com/en/7",), (None,), ("com/en/",)], "entry string")
    assert urls.matched(sides, listed, "hit", most_bytes=0).orderBy("page_id").select("page_id", "hit").collect() == urls.matched(sides, listed, "hit").orderBy("page_id").select("page_id", "hit").collect()
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_digest_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda b: 7)
    urls.DigestArray.save(["a", "b", "c"], str(tmp_path / "x"))
    assert urls.DigestArray(str(tmp_path / "x")).has(["c", "d", "a", ""]).tolist() == [True, False, True, False]


def test_languages(spark):
    r = random.Random(1)
    sides = {"aa": ["kalo", "mire", "tonas", "velka"], "bb": ["schung", "ßtark", "überz", "achte"], "ру": ["дома", "книга", "вода", "лес"]}
    rows = [(i, " ".join(r.choice(sides[g]) for _ in range(20)), g) for i, g in enumerate(["aa", "bb", "ру"] * 30)]
    rows += [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "", None), (1003, " ".join(["kalo"] * 12 + ["schung"] * 8), None)]
    df = spark.createDataFrame([(*x, "x") for x in rows], "doc_id long, text string, lang string, score string")
    model = languages.train(df, F.col("doc_id") % 3 != 5)
    got = {r.doc_id: r for r in languages.identify(df, model).collect()}
    assert all(got[i].lang_pred == g for i, _, g in rows[:90])
    assert all((got[i].lang_pred, got[i].score, got[i].spans) == ("und", 0.0, []) for i in (1000, 1001, 1002))
    assert [(s.lang, s.first, s.last) for s in got[1003].spans] == [("aa", 0, 11), ("bb", 12, 19)] and got[1003].lang_pred in ("aa", "bb")
    none = languages.train(empty(spark), F.lit(True))
    assert {r.lang_pred for r in languages.identify(df, none).collect()} == {"und"} and languages.identify(empty(spark), model).count() == 0


def test_viterbi_by_force():
    import itertools

    r = np.random.default_rng(0)
    counts = np.array([4, 0, 1, 3])
    scores = r.normal(size=(8, 3)).astype(np.float32) * 3
    got = languages.viterbi(scores, counts, 2.0)
    at = 0
    for n in counts:
        best = max((sum(scores[at + i, k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False)), path) for path in itertools.product(range(3), repeat=int(n)))[1]
        assert got[at : at + n].tolist() == list(best)
        at += n


def test_many_languages():
    labels = languages.viterbi(np.eye(200, dtype=np.float32)[[150, 150, 199]] * 9, np.array([3]), 2.0)
    assert labels.tolist() == [150, 150, 199]


def trigram_by_force(rows, learned, exact):
    """Scores of rows of words; probabilities go through the trie's codes unless exact."""
    start = ["\n", "\n"]
    c = Counter(x for w in learned for x in w)
    two = Counter(p for w in learned for p in zip(start[1:] + w, w, strict=False))
    three = Counter(p for w in learned for p in zip(start + w, start[1:] + w, w, strict=False))
    after, after2, times2 = Counter(h for h, _ in two), Counter(p[:2] for p in three), Counter()
    for p, k in three.items():
        times2[p[:2]] += k
    n = sum(c.values()) + len(c) + 1
    code = (lambda p: np.log10(p)) if exact else lambda p: lm.dequantised(lm.quantised(np.log10(p)).astype(float))
    out = []
    for w in rows:
        total = 0.0
        for g, h, x in zip(start + w, start[1:] + w, w, strict=False):
            p = code((c[x] + 1) / n)
            if c[h]:
                weight = min(1, 0.75 * after[h] / c[h])
                p = code(max(two[h, x] - 0.75, 0) / c[h] + weight * 10**p) if two[h, x] else p + code(weight)
            if times2[g, h]:
                weight = min(1, 0.75 * after2[g, h] / times2[g, h])
                p = code(max(three[g, h, x] - 0.75, 0) / times2[g, h] + weight * 10**p) if three[g, h, x] else p + code(weight)
            total += p
        out.append(total)
    return out


def test_lm_scores(spark, docs, by_id):
    learn = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    got = defaultdict(list)
    for r in lm.score(docs, learn).collect():
        got[r.doc_id].append(r)
    rows = [(r.doc_id, [*WORD.findall(lowered(r.text)), "\n"]) for r in docs.collect()]
    seen = [w for k, w in rows if zlib.crc32(str(k).encode()) % 7 != 2]
    c = Counter(x for w in seen for x in w)
    n, v = sum(c.values()), len(c)
    exact, coded = (trigram_by_force([w for _, w in rows], seen, e) for e in (True, False))
    assert sum(map(len, got.values())) == len(rows) and len(got[0]) == 2 and len(set(got[0])) == 1  # the row that repeats
    for (k, w), x, y in zip(rows, exact, coded, strict=True):
        r = got[k][0]
        assert r.n_tokens == len(w) and r.train_tokens == n and r.n_known == sum(x in c for x in w)
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert r.score == pytest.approx(y) and abs(y - x) <= 0.05 * len(w)
    assert lm.score(empty(spark), F.lit(True)).count() == 0
    blind = lm.score(docs, F.lit(None).cast("boolean")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in blind)
    assert lm.score(docs, learn, tries=True).count() >= 1
    odd = spark.createDataFrame([(None, "a b"), (None, None), (3, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in lm.score(odd, F.lit(True)).collect()) == [(0, 1), (0, 3), (3, 3)]


@pytest.mark.parametrize("parts, spread", [(3, 10**6), (17, 10**6), (1, 5), (4, 5), (31, 2), (4, 1)])
def test_lm_scores_do_not_depend_on_shards(spark, monkeypatch, parts, spread):
    texts = ["a b", "a c", "a d", "a b e", "hot " * 40 + "hot a", *(f"hot x{i}" for i in range(30)), *(f"a y{i} hot" for i in range(9))]
    held_out = ["a z", "hot z hot a", "x1 a hot x3", "z z", "hot hot hot hot", "y3 hot hot"]
    docs = spark.createDataFrame(list(enumerate(texts + held_out)), "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    monkeypatch.setattr(lm, "SPREAD", spread)
    try:
        got = {r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") < len(texts)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = [[*t.split(), "\n"] for t in texts + held_out]
    for k, want in enumerate(trigram_by_force(rows, rows[: len(texts)], exact=False)):
        assert got[k] == pytest.approx(want, abs=1e-9), rows[k]


def test_elias_fano_ranges():
    r = np.random.default_rng(4)
    sizes = r.integers(0, 9, 300)
    first = common.starts(sizes)
    rank = np.concatenate([np.sort(r.choice(40, n, replace=False)) for n in sizes])
    values = lm.laid(first, rank)
    assert (np.diff(values) > 0).all()
    found, _ = lm.EliasFano.view(np.frombuffer(lm.EliasFano.pack(values), np.uint8), 0)
    assert found.get(np.arange(len(values))).tolist() == values.tolist()
    which, asked = r.integers(0, 300, 5000), r.integers(0, 45, 5000)
    want = [next((j for j in range(first[i], first[i + 1]) if rank[j] == x), -1) for i, x in zip(which, asked, strict=True)]
    assert found.find_in(first[which], first[which + 1], asked).tolist() == want


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, top in ((0, 9), (1, 1), (900, 4000), (900, 10**13), (3000, 3000)):
        values = np.unique(r.integers(0, top, n)) if n < top else np.arange(n)
        found, _ = lm.EliasFano.view(np.frombuffer(lm.EliasFano.pack(values), np.uint8), 0)
        asked = np.concatenate((values, r.integers(0, top + 5, 500))).astype(np.int64)
        place = {int(x): i for i, x in enumerate(values)}
        assert found.find(asked).tolist() == [place.get(int(x), -1) for x in asked]


def leaks_by_force(by_id, items):
    runs = lambda t: [tuple(w[i : i + 5]) for w in [WORD.findall((t or "").lower())] for i in range(len(w) - 4)]
    out = {}
    for d, t in by_id.items():
        s = runs(t)
        for i, text in items.items():
            item = Counter(runs(text))
            n = sum(item.values())
            best = 0.0
            for at in range(max(1, len(s) - n + 1)) if n and s else ():
                w = Counter(s[at : at + n])
                both = sum((w & item).values())
                best = max(best, both / (sum(w.values()) + n - both))
            if best >= 0.8:
                out[d, i] = round(best, 6)
    return out


def test_leaks(spark):
    r = random.Random(8)
    words = [f"vñ{i}" for i in range(400)]
    items = {i: " ".join(r.choice(words) for _ in range(n)) for i, n in enumerate((14, 20, 36, 36, 60, 3))}
    rows = {}
    for d in range(60):
        body = [r.choice(words) for _ in range(r.randint(0, 80))]
        if d % 3 == 0:
            item = items[d % 5].upper().split(" ")
            if d % 2:
                item[len(item) - 1 if d % 4 == 1 else len(item) // 2] = "other"
            p = r.randint(0, len(body))
            body[p:p] = item
        rows[d] = " \t".join(body)
    rows[60], rows[61], rows[62] = None, "", items[4].rsplit(" ", 5)[0]
    df = spark.createDataFrame([(k, t, 1, 1, 1) for k, t in [*rows.items(), (0, rows[0])]], "doc_id long, text string, h int, length int, item int")
    bench = spark.createDataFrame([*items.items(), (99, None), (0, items[0])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in leaks.leaks(df, bench).collect()}
    want = leaks_by_force(rows, items)
    assert want and got == want
    kept = leaks.decontaminate(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(rows) - {d for d, _ in want}
    assert leaks.leaks(empty(spark), bench).count() == 0 and leaks.leaks(df, bench.limit(0)).count() == 0


def test_toxicity(spark):
    r = random.Random(6)
    clean, bad = [f"word{chr(97 + i)}" for i in range(26)], ["rotten", "vile", "Rottenness"]
    rows = []
    for i in range(400):
        w = [r.choice(clean) for _ in range(40)]
        if i % 4 == 0:
            for _ in range(1 + i // 4 % 6):
                w[r.randrange(40)] = r.choice(bad) + "!"
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string").withColumns({"grade": F.lit("x"), "toxic": F.lit("y")})
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    assert (np.diff(model.cuts) > 0).all() and len(model.weights) == toxicity.VIEWS * len(model.features)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [(i, y) for i, _, y in rows if i % 3 == 0]
    assert np.mean([got[i].toxic == bool(y) for i, y in held]) > 0.9 and not got[900].toxic and not got[901].toxic
    assert all(0 <= r.severity <= 3 and r.grade in range(4) for r in got.values())
    assert np.mean([got[i].severity for i, y in held if y]) > np.mean([got[i].severity for i, y in held if not y]) + 0.5
    kept = toxicity.clean(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.toxic}
    assert toxicity.score(empty(spark), model).count() == 0
    assert not any(r.toxic for r in toxicity.score(df, toxicity.fit(df, labels.limit(0))).collect())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(c.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() <= before and (docs.columns == columns) == (i < len(c.STAGES) - 1)
        before = docs.count()
    want = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in docs.collect()}
    assert want and {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in c.run(spark, sf).collect()} == want


def test_queries_are_whole(spark):
    from pulselake.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op1_bpe", "op2_fingerprints", "op3_toxicity", "op4_line_dedup", "op5_token_files", "op6_language_id", "op7_lm_scoring", "op9_jaccard_join"):
        assert queries.QUERIES[name](spark, sf).count() == docs, name
    r = queries.op1_bpe(spark, sf).first()
    assert re.fullmatch("[0-9a-f]{64}", r.ids_sha256) and re.fullmatch("[0-9a-f]{64}", r.decoded_sha256) and hashlib.sha256(b"").hexdigest() != r.ids_sha256

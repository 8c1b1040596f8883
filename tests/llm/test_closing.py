"""What the closing step of large groups leaves out, and that it loses no link."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.llm import jaccard


@pytest.mark.parametrize("n", [1000, 2000])
def test_members_of_one_large_group_have_nothing_to_close(spark, n):
    """Unlike members that share a single group are left out, whatever their number."""
    one = spark.range(n).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("node"))
    assert jaccard.worth_closing(one).count() == 0
    two = one.union(spark.range(20).select(F.lit(8).cast("long"), F.col("id")))
    assert jaccard.worth_closing(two).groupBy("key").count().orderBy("key").collect() == [(7, 20), (8, 20)]
    assert jaccard.worth_closing(one.limit(0)).count() == 0


@pytest.mark.parametrize("size", [12, 60, 400])
def test_similar_sets_share_two_blocks(size):
    """What worth_closing() rests on: of random sets at the threshold, every pair has two keys in common."""
    r = random.Random(size)
    for _ in range(300):
        n = r.randint(max(2, size // 2), size)
        a = [r.getrandbits(63) for _ in range(n)]
        out = r.randint(0, n // 9)
        b = a[out:] + [r.getrandbits(63) for _ in range(r.randint(0, n // 9))]
        both = len(set(a) & set(b))
        if a == b or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        keys, count = jaccard.block_keys(np.array([*a, *b], np.uint64), np.array([len(a), len(b)]))
        assert len(set(keys[: count[0]].tolist()) & set(keys[count[0] :].tolist())) >= 2


def test_large_groups_by_brute_force(spark):
    """A passage that all documents have, and chains of near copies among them."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(60):
        own = [word() for _ in range(r.choice([8, 30, 60]))]
        for _ in range(r.choice([1, 1, 4])):
            texts.append(" ".join(passage + own))
            own = own.copy()
            own[r.randrange(len(own))] = word()
    texts += [" ".join(passage[:k]) for k in range(20, 41)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    least = list(range(len(texts)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = root(i), root(j)
                least[max(x, y)] = min(x, y)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in jaccard.join(df.repartition(5)).collect()}
    assert got == {i: root(i) for i in range(len(texts))} and len(set(got.values())) < len(texts) - 20

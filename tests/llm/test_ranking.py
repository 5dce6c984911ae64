"""Ranked search: against a plain ranking of all documents, over small shards and blocks, early ends, and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidegauge.llm import ranking
from tidegauge.session import prepare

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k):
    docs = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs if d is not None]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    total, df = sum(n for *_, n in docs), Counter(t for _, c, _ in docs for t in c)
    wanted: dict = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        scored = []
        for d, c, n in docs:
            m = 100 - 50 + 50 * n * len(docs) // total
            score = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(df):
    return sorted((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


def corpus(rng, n):
    words = [f"w{k}" for k in range(60)] + ["É", "é", "naïve", "X1"]
    weights = [1 / (k + 1) for k in range(len(words))]
    text = lambda most: rng.choice([" ", "-", "\n"]).join(rng.choices(words, weights, k=rng.randint(0, most)))
    docs = [(d, text(40)) for d in range(n)]
    docs += [(n + k, docs[k % 7][1]) for k in range(60)]  # equal scores
    return docs, [(i, text(12)) for i in range(25)]


@pytest.mark.parametrize("block_bytes", [100, 1 << 20])
def test_against_a_plain_ranking(spark, block_bytes):
    docs, items = corpus(random.Random(1), 700)
    got = ranking.search(
        prepare(spark).createDataFrame(docs, "doc_id long, text string").repartition(4), prepare(spark).createDataFrame(items, "item_id long, text string"), k=7, block_bytes=block_bytes)
    assert found(got) == plain(docs, items, 7)


def test_a_shard_ends_early_and_is_exact():
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(40, rng.integers(1, 20), replace=False)) for _ in range(4000)]
    ends = np.append(0, np.cumsum([len(r) for r in rows]))
    ids, impact = np.concatenate(rows), rng.integers(1, 50, ends[-1]) * rng.integers(1, 50, ends[-1])
    shard, docs = ranking.Shard(np.arange(4000) * 3 % 4001, ends, ids, impact), np.arange(4000) * 3 % 4001
    for query in (np.array([3]), np.array([1, 5, 9]), np.arange(12), np.array([39, 41]), np.array([77])):
        wanted = np.zeros(80, bool)
        wanted[query] = True
        whole = np.array([impact[s:e][wanted[ids[s:e]]].sum() for s, e in zip(ends[:-1], ends[1:])])
        order = np.lexsort((docs, -whole))[:10]
        order = order[whole[order] > 0]
        doc, score, read = shard.search(query, wanted, 1, 10)
        assert doc.tolist() == docs[order].tolist() and score.tolist() == whole[order].tolist()
        assert read <= wanted[ids].sum()
        if len(order):
            floor = int(whole[order[3]])
            again, _, less = shard.search(query, wanted, floor, 10)
            assert again.tolist() == [d for d, s in zip(doc.tolist(), score.tolist()) if s >= floor] and less <= read
            assert shard.search(query, wanted, int(whole.max()) + 1, 10)[0].tolist() == []
    wanted = np.zeros(80, bool)
    wanted[[1, 5, 9]] = True
    assert shard.search(np.array([1, 5, 9]), wanted, 1, 10)[2] < wanted[ids].sum() / 2


def test_shards_of_a_task(spark):
    """Batches of many documents are several shards, whose k-th scores go on."""
    docs, _ = corpus(random.Random(4), 300)
    slices = list(ranking._slices(iter([])))
    assert slices == []
    items = [(1, "w0 w1 w2 w3"), (2, "w0"), (3, "zzz"), (4, None), (5, ""), (None, "w1"), (1, "W9 w1")]
    spark_docs = prepare(spark).createDataFrame([(d, t, "a", 1, 2.0) for d, t in docs] + [(None, "w0 w1", "a", 1, 2.0), (3, "w0 w9", "a", 1, 2.0), (7, None, None, None, None), (8, "w1 " * 300_000, "x", 0, 0.0)], "doc_id long, text string, item string, rank int, score double").repartition(1)
    rows = [(r.doc_id, r.text) for r in spark_docs.collect()]
    got = ranking.search(spark_docs, prepare(spark).createDataFrame([(*i, 3, "q") for i in items], "item_id long, text string, doc_id int, n string"))
    assert found(got) == plain(rows, items, 50)
    none = spark_docs.limit(0)
    assert ranking.search(none, prepare(spark).createDataFrame(items, "item_id long, text string")).count() == 0
    assert ranking.search(spark_docs, prepare(spark).createDataFrame([], "item_id long, text string")).count() == 0

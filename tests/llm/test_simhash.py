"""SimHash: fingerprints against a plain computation, links against all pairs, and odd rows."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from compare import DATA
from tidegauge.llm import simhash
from tidegauge.llm.common import load
from tidegauge.session import prepare


def plain(text) -> int:
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    runs = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    digests = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(d >> k & 1 for d in digests) > len(digests))


def plain_components(rows) -> dict:
    """(doc_id -> least doc_id) of rows (doc_id, fingerprint)."""
    owners: dict = {}
    for doc, fp in rows:
        owners.setdefault(fp, []).append(doc)
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        x, y = sorted((find(a), find(b)))
        root[y] = x

    fps = np.array(sorted(owners), np.uint64)
    for k, fp in enumerate(fps):
        for other in fps[np.bitwise_count(fps ^ fp) <= 4]:
            for d in owners[int(other)]:
                join(owners[int(fp)][0], d)
    return {d: find(d) for d in root}


def test_triples_cover_all_fours():
    assert len(simhash.TRIPLES) == len(set(simhash.TRIPLES)) == 20
    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in combinations(range(8), 4))


def test_digest_is_that_of_the_engine(spark):
    row = prepare(spark).range(1).select(F.xxhash64(F.lit("ünï cödé 4 words")).alias("h")).first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest("ünï cödé 4 words".encode(), 42)


def test_whole_documents(spark):
    docs = load(prepare(spark), DATA, "documents")
    got = simhash.near_fingerprints(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    assert all(int(r.fingerprint, 16) == plain(texts[r.doc_id]) and len(r.fingerprint) == 16 for r in got)
    expected = plain_components([(r.doc_id, int(r.fingerprint, 16)) for r in got])
    assert {r.doc_id: r.component_id for r in got} == expected


@pytest.mark.parametrize("block", [7, 2048])
def test_links_of_crowded_fingerprints(spark, block):
    """Chains, clouds around one fingerprint, pairs at 4 and 5 bits, and lists of many groups."""
    rng = random.Random(3)
    flipped = lambda fp, n: fp ^ sum(1 << b for b in rng.sample(range(64), n))
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(300)} | {flipped(centre, rng.randint(3, 12)) for _ in range(400)}
    low = rng.getrandbits(32)
    fps |= {low | rng.getrandbits(32) << 32 for _ in range(150)}  # the same list for some triples, far apart
    for fp in list(fps)[:150]:
        fps |= {flipped(fp, 4), flipped(fp, 5)}
    chain = rng.getrandbits(64)
    for _ in range(60):
        chain = flipped(chain, 4)
        fps.add(chain)
    fps |= {0, 1, 2**64 - 1, 2**63}
    ids = {fp: k for k, fp in enumerate(sorted(fps, key=lambda _: rng.random()))}
    signed = lambda fp: fp - 2**64 if fp >= 2**63 else fp
    nodes = prepare(spark).createDataFrame([(signed(fp),) for fp in fps], "node long").repartition(3)
    found = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(nodes, block).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    root = {d: d for d in ids.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        x, y = sorted((find(ids[a]), find(ids[b])))
        root[y] = x
    assert {d: find(d) for d in root} == plain_components([(d, fp) for fp, d in ids.items()])


def test_odd_rows(spark):
    long = " ".join(f"w{k % 977}" for k in range(200_000))
    texts = [None, "", " \t\n", "One", "one", "a B  c", "A b\tC", "x " * 50_000, long, long + " tail", "é É \x00 \x0b four five"]
    data = [(k, t, "p", 1, "l", 2) for k, t in enumerate(texts)] + [(4, "one", "p", 1, "l", 2), (3, "quite another text with words", None, None, None, None), (None, "one", "p", 1, "l", 2)]
    docs = prepare(spark).createDataFrame(data, "doc_id long, text string, fp string, node int, list string, least int").repartition(2)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_fingerprints(docs).collect()), key=str)
    assert sorted((d, f) for d, f, _ in got if d is not None) == sorted((d, f"{plain(t):016x}") for d, t, *_ in data if d is not None)
    by_id = {d: c for d, _, c in got}
    assert by_id[None] is None and by_id[0] == by_id[1] == by_id[2] == 0 and by_id[3] == by_id[4] == 3 and by_id[5] == by_id[6] == 5 and by_id[8] == by_id[9] == 8
    assert simhash.near_fingerprints(docs.limit(0)).count() == 0

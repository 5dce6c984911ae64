"""The Merkle manifest: against a plain recursion, over several strides of levels, and odd rows."""

import hashlib
import random
import zlib

import pytest

from tidegauge.llm import merkle
from tidegauge.session import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos string, tree int, row int, path string, hash string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])))


def plain_tree(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[k : k + 2])) for k in range(0, len(last), 2)])
    return levels


def climbed(levels, at, digest):
    """Siblings of a leaf, and the root that ``digest`` in its place gives."""
    path = []
    for level in levels[:-1]:
        pair = level[at // 2 * 2 : at // 2 * 2 + 2]
        path += [h for k, h in enumerate(pair) if k != at % 2]
        digest = sha("".join(digest if k == at % 2 else h for k, h in enumerate(pair)))
        at //= 2
    return path, digest


def plain(rows: list[dict]) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        n = r["n_chars"]
        changed = r | {"n_chars": n + 1} if r["doc_id"] is not None and n is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 else r
        groups.setdefault(r["lang"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r), plain_leaf(changed)), r["doc_id"]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[0][2] for x in sorted(groups[g], key=lambda x: x[0])]) for g in order}
    top = plain_tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for at, ((_, _, leaf, claimed), doc) in enumerate(sorted(groups[g], key=lambda x: x[0])):
            low, root = climbed(trees[g], at, claimed)
            high, root = climbed(top, k, root)
            out.append((doc, leaf, trees[g][-1][0], top[-1][0], sha("".join(low + high)), root, root == top[-1][0]))
    return sorted(out, key=str)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def made(rng, n, langs):
    text = lambda: rng.choice([None, "", "a", "é" * rng.randint(1, 9), "x y " * rng.randint(1, 50)])
    rows = [{"doc_id": i, "text": text(), "lang": rng.choice(langs), "source": rng.choice([None, "s", "-"]), "n_chars": rng.choice([None, i, 7])} for i in range(n)]
    return [r | {"pos": "p", "tree": 1, "row": None, "path": "q", "hash": "h"} for r in rows]


@pytest.mark.parametrize("stride", [1, 2, 12])
@pytest.mark.parametrize("n", [1, 37])
def test_against_a_plain_recursion(spark, stride, n):
    rows = made(random.Random(n), n, [None, "", "a", "b", "é", "Z"])
    docs = prepare(spark).createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA).repartition(3)
    assert found(merkle.manifest(docs, merkle.tampered_leaf(), stride=stride)) == plain(rows)


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = made(rng, 9, ["one"])
    rows += [rows[3], rows[3], {**rows[4], "text": "other"}, {**rows[1], "doc_id": None}, {**rows[2], "text": "long " * 400_000}]
    docs = prepare(spark).createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
    got = found(merkle.manifest(docs, merkle.tampered_leaf()))
    assert got == plain(rows) and len(got) == len(rows)
    whole = merkle.manifest(docs).collect()
    assert all(r.verified for r in whole) and {r.folded_root for r in whole} == {got[0][3]}
    empty = merkle.manifest(docs.limit(0))
    assert empty.count() == 0 and len(empty.columns) == 7

"""Every operator and pipeline stage with extra columns of the operators' own names: no crash, and the values come back unchanged."""

import random

import pytest

import corpus_pipeline
from tidegauge.llm import archives, decontamination, dedup, lengths, merkle, mixing, quality, ranking, secrets, simhash, tokenfiles, topk, toxicity
from tidegauge.session import prepare

NAMES = "_doc _label _text _words _row _s _key _copy _block _id _in _seq _b hash node hub head cluster page page_id keeper digest payload bytes label value item item_id terms counts n row tree pos path place part group claimed fp list a b least component hits h w s query shard vector id doc start bh p q left right bands sketch shingles n_shingles size copies taken target total share weight model".split()


@pytest.fixture(scope="module")
def crowded(spark):
    """Documents with labels and one item, and a column of each internal name: texts that name it."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 30))) for _ in range(40)]
    texts[7] = texts[3]
    texts[9] = "an item of eight words that leaks here " + texts[9]
    rows = [(k, t, "en", f"s{k % 2}", len(t), *[f"{n} {k}" for n in NAMES]) for k, t in enumerate(texts)]
    rows.append((None, "and an item of eight words that leaks here too", "en", "s1", 4, *[f"{n} none" for n in NAMES]))
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))
    labels = spark.createDataFrame([(k, k % 2, int(k % 5 == 0), "x", "y") for k in range(40)], "doc_id long, quality int, toxic int, _label string, label string")
    items = spark.createDataFrame([(1, "an item of eight words that leaks here", "x", 2)], "item_id long, text string, doc_id string, n_item int")
    return docs, labels, items


@pytest.mark.parametrize("name", ["mixture", "quality", "secrets", "toxicity", "contained", "tokens", "lengths", "near", "simhash", "ranking", "merkle"])
def test_operator(crowded, name):
    docs, labels, items = crowded
    run = {
        "mixture": lambda d: mixing.mixture(d), "quality": lambda d: quality.predictions(d, labels), "secrets": lambda d: secrets.findings(d), "toxicity": lambda d: toxicity.predictions(d, labels),
        "contained": lambda d: decontamination.contained(d, items), "tokens": lambda d: tokenfiles.round_trip(d), "lengths": lambda d: lengths.context_table(lengths.length_histogram(d)),
        "near": lambda d: dedup.near_duplicates(d), "simhash": lambda d: simhash.near_fingerprints(d), "ranking": lambda d: ranking.search(d, items), "merkle": lambda d: merkle.manifest(d),
    }[name]
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    assert sorted(map(str, run(docs).collect())) == sorted(map(str, run(plain).collect()))


@pytest.mark.parametrize("stage", ["without_toxic", "without_duplicates", "without_items", "mixed"])
def test_rows_come_back_unchanged(crowded, stage):
    docs, labels, items = crowded
    run = {"without_toxic": lambda d: toxicity.without_toxic(d, labels), "without_duplicates": dedup.without_duplicates, "without_items": lambda d: decontamination.without_items(d, items), "mixed": mixing.mixed}[stage]
    got = run(docs)
    assert got.schema == docs.schema
    rows = {tuple(r) for r in got.collect()}
    assert rows and rows <= {tuple(r) for r in docs.collect()}
    kept = {r[0] for r in rows}
    if stage == "without_duplicates":
        assert kept == set(range(40)) - {7} | {None}
    if stage == "without_items":
        assert kept == set(range(40)) - {9}


def test_pages_and_vectors(spark):
    pages = prepare(spark).createDataFrame([(k, f"http://a.b/{k}", "<p>" + "x" * 1200, *[f"{n} {k}" for n in NAMES if n != "page_id"]) for k in range(5)], "page_id long, url string, html string, " + ", ".join(f"`{n}` string" for n in NAMES if n != "page_id"))
    assert {(r.page_id, r.refers_to) for r in archives.round_trip(pages).collect()} == {(k, 4 if k < 4 else None) for k in range(5)}
    vectors = spark.createDataFrame([(k, [0.1 * k, 0.5], *[f"{n} {k}" for n in NAMES]) for k in range(60)], "vec_id long, embedding array<float>, " + ", ".join(f"`{n}` string" for n in NAMES))
    assert topk.nearest(vectors).count() == 10


def test_stages_are_of_the_pipeline():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]

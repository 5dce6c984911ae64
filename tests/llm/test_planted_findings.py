"""Labelled findings planted into the prose of the given documents: what the forest learns beyond the rule, on findings held out; and the optima of the other classifiers against plain solvers."""

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from compare import DATA
from tidegauge.llm import quality, secrets
from tidegauge.llm.common import load
from tidegauge.session import prepare

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def planted(rng: random.Random, kind: str) -> tuple[str, str, int]:
    """(text around with {}, value, label) of a finding of a kind."""
    key = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(20, 40)))
    digest = hashlib.sha1(key.encode()).hexdigest()
    name = rng.choice(["token", "api_key", "secret", "auth_token", "password"])
    if kind == "key":  # a credential as the rule sees it
        return f" deploy login {name} = '{{}}' for production ", key, 1
    if kind == "digest":  # a digest under a credential's name: the rule is wrong
        return f" commit checksum verify {name}: {{}} of the archive build ", digest, 0
    if kind == "path":  # an identifier below a path of caches, under a credential's name
        return f" {name}=/var/cache/build/{{}} artifact ", f"{rng.randrange(10**15, 10**16)}-{rng.randrange(10**6)}", 0
    if kind == "bare":  # a key without a name: the rule says nothing
        return " export login production {} ", base64.b64encode(rng.randbytes(24)).decode().rstrip("="), 1
    return " checksum archive verify {} build ", hashlib.md5(key.encode()).hexdigest(), 0


def test_the_forest_learns_more_than_the_rule(spark):
    rng, kinds = random.Random(8), ("key", "digest", "path", "bare", "plain digest")
    prose = [t.split()[:60] for (t,) in load(prepare(spark), DATA, "documents").select("text").where("length(text) > 200").collect()]
    docs, labels, kind_of = [], [], {}
    for doc in range(500):
        words, text = rng.choice(prose), ""
        for kind in rng.sample(kinds, 3):
            at = rng.randrange(len(words))
            around, value, label = planted(rng, kind)
            text += " ".join(words[:at]) + around.format(value)
            start = len(text) - len(around.format(value)) + around.index("{}")
            labels.append((doc, start, label))
            kind_of[doc, start] = kind
        docs.append((doc, text + " ".join(words)))
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(labels, "doc_id long, start int, label int")
    truth = {(r.doc_id, r.start): r.label for r in labels.collect()}
    rule = {(r.doc_id, r.start): r.weak == 1 for r in secrets.candidates(docs).collect()}
    got = [r for r in secrets.findings(docs, labels.unionByName(labels.limit(5))).collect() if r.held_out and (r.doc_id, r.start) in truth]
    assert len(got) > 250

    def figures(kept) -> tuple[float, float]:
        hit = sum(truth[r.doc_id, r.start] for r in got if kept(r))
        return hit / sum(1 for r in got if kept(r)), hit / sum(truth[r.doc_id, r.start] for r in got)

    forest, plain = figures(lambda r: r.kept), figures(lambda r: rule[r.doc_id, r.start])
    print("held-out precision and recall: forest", forest, "rule", plain, "of", len(got))
    assert forest[0] > 0.95 and forest[1] > 0.95 and forest[0] > plain[0] + 0.2 and forest[1] > plain[1] + 0.2
    wrong = {kind_of[r.doc_id, r.start] for r in got if kind_of[r.doc_id, r.start] == "digest" and rule[r.doc_id, r.start]}
    assert wrong == {"digest"}  # there are digests that the rule takes for secrets


def test_hinge_descent_reaches_the_optimum(spark):
    """The primal objective of the weights is that of a projected-gradient solution of the same dual, on 40 rows."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["good", "fine", "bad", "poor", "text", "word", f"w{k % 7}"]) for _ in range(6)) for k in range(40)]
    y = [int(t.count("good") + t.count("fine") > t.count("bad") + t.count("poor")) for t in texts]
    table = pa.table({"text": texts, "label": pa.array(y, pa.int32())})
    model = quality.fit(table, {0: 1.0, 1: 1.0})
    with np.errstate(over="ignore"):
        rows = []
        for n, row, feature in quality._pieces(table["text"].combine_chunks()):
            rows += np.split(feature.astype(np.int32), np.searchsorted(row, np.arange(1, n)))
    on = np.array([k for k in range(40) if k % 5 != 4])
    counts = np.full((2, quality.SIZE), quality.SMOOTH)
    for i in on:
        counts[y[i], rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    used = np.unique(np.concatenate(rows))
    x = np.zeros((len(on), len(used)))
    for k, i in enumerate(on):
        x[k, np.searchsorted(used, rows[i])] = ratio[rows[i]] / np.sqrt(len(rows[i]))
    sign = np.where(np.array(y)[on] == 1, 1.0, -1.0)
    share = np.array([(sign < 0).mean(), (sign > 0).mean()])
    cost = quality.COST / (2 * share)[(sign > 0).astype(int)]
    primal = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - sign * (x @ w))).sum()
    gram, alpha = (x * sign[:, None]) @ (x * sign[:, None]).T, np.zeros(len(on))
    for _ in range(200_000):
        new = np.clip(alpha - (gram @ alpha - 1) / np.linalg.norm(gram, 2), 0, cost)
        if np.abs(new - alpha).max() < 1e-13:
            break
        alpha = new
    best = primal((alpha * sign) @ x)
    assert alpha.sum() - 0.5 * alpha @ gram @ alpha == pytest.approx(best, rel=1e-4)  # no gap: it is the optimum
    scaled = np.divide(model.weights[used], ratio[used], out=np.zeros(len(used)), where=ratio[used] != 0)
    assert primal(scaled) <= best * 1.02

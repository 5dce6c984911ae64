"""Secret candidates, and a random forest that removes false positives.

Candidates are runs of at least 16 characters of keys, hashes and base64; values
of at least 6 characters other than white space that are assigned to a
credential's name; and passwords in URLs (user:password@). A forest on their length, the transitions
between kinds of characters, the part that words of a dictionary cover, the parts
of the path they stand in and the words around them (both as hashed indicators)
says which are secrets. The dictionary is counted over all documents.

The forest learns from labelled findings (doc_id, start, label). Where none are
given, findings are labelled by rules: a value of a credential's name is a
secret, while numbers without letters, words, placeholders and values of the names of
hashes, commits, digests, ids and examples aren't. Other candidates, among them
all that have letters and no assignment, stay unlabelled: the forest tells them
by shape and surroundings. What the rules look at to call a value a secret (its
assignment, the quotes that come with it, and the names of credentials nearby) is
then hidden from the forest.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import crc_mod, written

#: Findings of each class, and of each kind of label by rule, that the forest learns from, about.
PER_CLASS = 5000
TREES, DEPTH, SEED = 20, 6, 13
#: Characters before and after a candidate that its context is taken from.
CONTEXT = 48
#: Words of the dictionary at most, their letters, and documents that a word must stand in.
DICTIONARY, LETTERS, LEAST_DOCS = 20_000, (3, 20), 3
#: Nearest words on each side, and hashed indicators of them and of the parts of the path.
NEAREST, WORD_BUCKETS, PATH_BUCKETS = 4, 64, 16

# Names that are given to credentials.
# and parts of names, or words nearby, that speak of something that is no secret.
CREDENTIAL_NAMES = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "access_key", "auth", "credential", "private_key")
BENIGN_NAMES = frozenset("hash sha sha1 sha224 sha256 sha384 sha512 md5 crc crc32 checksum digest commit revision rev etag fingerprint integrity id ids uuid guid example sample placeholder dummy fake test".split())

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=\-]{16,}")
_ASSIGNED = re.compile(r"""([A-Za-z_][A-Za-z0-9_.\-]{1,39})["']?\s{0,3}(?::=|=>|==?|:)\s{0,3}["']?$""")
_WORD = re.compile(r"[^\W\d_]+")
_PART = re.compile(r"[A-Z]?[a-z]+[0-9]*|[A-Z]+[0-9]*(?![a-z])")
_TOKEN = re.compile(r"[^\W_]+")
_JOINED_BEFORE, _JOINED_AFTER = re.compile(r"[^\s\"'<>()\[\]=,;|]*$"), re.compile(r"[^\s\"'<>()\[\]=,;|]*")
_PLACEHOLDER = re.compile(r"(?i)(?:your|change.?me|example|sample|placeholder|dummy|redacted|insert|replace|<|\$\{|\{\{|%\()|(?:null|none|true|false|undefined|\$[A-Z_]+|(.)\1*)$")
_SEPARATOR = re.compile(r":=|=>|==?|:")
_VALUE = re.compile(r"""(?i)\s{0,3}(?:(bearer|basic|digest|token)\s{1,3})?(?:"([^"\s]{6,})|'([^'\s]{6,})|([^\s"']\S{5,}))""")
_INNER = re.compile(r"""\s{0,3}["']?([A-Za-z_][A-Za-z0-9_.\-]{1,39})["']?(?::=|=>|==?|:)""")
_USERINFO = re.compile(r"://[^\s/@:]*:(?!\d{1,5}[?#])([^\s/]+)@")
_MARKS = frozenset("!@#$%^&*?+~|")
FEATURES = ("length", "digits", "uppers", "lowers", "symbols", "transitions", "hex_only", "entropy", "coverage", "path", "assigned", "quoted", "words_before", "words_after", "benign", "credential", *[f"word_{k}" for k in range(WORD_BUCKETS)], *[f"path_{k}" for k in range(PATH_BUCKETS)])
#: Features that labels by rule are made of, or that come with them: hidden from a forest that learns from those.
RULED = ("assigned", "quoted", "credential")


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def _parts(name: str) -> set[str]:
    """The words of an identifier, in lower case: of tokenHash, token_hash and TOKEN-HASH token and hash."""
    return {p.lower() for p in _PART.findall(name)}


def _credential(name: str | None) -> bool:
    return name is not None and any(k in name.lower() for k in CREDENTIAL_NAMES)


def spans(text: str) -> list[tuple[int, int, str | None]]:
    """(start, stop, name or None) of the candidates of a text, in order and without overlaps.

    Passwords in URLs go before values of credentials' names, and these before
    runs. Of an assignment inside a value the inner one counts. Closing
    brackets and punctuation aren't part of values without quotes.
    """
    found = [(m.start(1), m.end(1), "password") for m in _USERINFO.finditer(text)]
    urls, end = list(found), 0
    for m in _SEPARATOR.finditer(text):
        if m.start() < end or not _credential((name := _ASSIGNED.search(text[max(0, m.start() - CONTEXT) : m.end()])) and name.group(1)):
            continue
        inner = _INNER.match(text, m.end())
        if inner and _credential(inner.group(1)):
            continue
        value = _VALUE.match(text, m.end())
        if not value:
            continue
        start, stop = value.span(value.lastindex)
        if value.lastindex == 4:
            stop = start + len(value.group(4).rstrip("\"',;.)]}>"))
        if stop - start >= 6 and not any(start < b and a < stop for a, b, _ in urls):
            found.append((start, stop, None if value.group(1) else name.group(1)))  # a scheme stands between: no label by rule
            end = stop
    found.sort()
    out, at = [], 0
    for m in _CANDIDATE.finditer(text):
        start, stop = m.span()
        cut = m.group().rstrip("=").rfind("=") + 1
        if cut and stop - start - cut >= 16:
            start += cut  # name=value without quotes
        while at < len(found) and found[at][1] <= start:
            at += 1
        if (at == len(found) or found[at][0] >= stop) and any(c.isalnum() for c in text[start:stop]):
            name = _ASSIGNED.search(text[max(0, start - CONTEXT) : start])
            out.append((start, stop, name and name.group(1)))
    return sorted(found + out, key=lambda x: x[:2])


def rule(value: str, name: str | None, dictionary: frozenset[str] = frozenset()) -> tuple[int | None, int]:
    """The label that rules give to a value of a name (None: no assignment), or None; and the kind of it: 1 secrets, 2 numbers, 3 named, 4 words."""
    credential = _credential(name)
    if not any(c.isalpha() for c in value):
        return (None, 0) if credential else (0, 2)
    if _PLACEHOLDER.match(value):
        return 0, 3
    if name is not None and BENIGN_NAMES & _parts(name):
        return (None, 0) if credential else (0, 3)
    letters = "".join(c for c in value if c.isalpha())
    plain = not any(c.isdigit() or c in _MARKS for c in value) and (letters.islower() or letters.isupper() or letters.istitle())
    if plain and (name is None or letters.lower() in dictionary):
        return 0, 4
    return (1, 1) if credential and any(c.isdigit() or c in _MARKS for c in value) and not any(c in "()[]{}<>" for c in value) else (None, 0)


def covered(value: str, dictionary: frozenset[str]) -> float:
    """The share of a value's characters that words of the dictionary cover at most, without overlaps and inside its runs of letters."""
    best = 0
    for run in _WORD.findall(value):
        run, most = run.lower(), [0] * (len(run) + 1)
        for end in range(1, len(run) + 1):
            most[end] = most[end - 1]
            for size in range(LETTERS[0], min(LETTERS[1], end) + 1):
                if most[end - size] + size > most[end] and run[end - size : end] in dictionary:
                    most[end] = most[end - size] + size
        best += most[-1]
    return best / max(1, len(value))


def _indicators(words: list[str], buckets: int) -> list[float]:
    out = [0.0] * buckets
    for w in words:
        out[zlib.crc32(w.encode("utf-8", "replace")) % buckets] = 1.0
    return out


def describe(candidate: str, before: str, after: str, dictionary: frozenset[str] = frozenset()) -> list[float]:
    """The features of a candidate in its context, in the order of FEATURES.

    Words of credentials' names are in no hashed indicator: ``credential`` stands for them.
    """
    n, kinds = len(candidate), [_kind(c) for c in candidate]
    counts, lower = Counter(kinds), candidate.lower()
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(candidate).values())
    near = [w.lower() for w in _TOKEN.findall(before)[-NEAREST:] + _TOKEN.findall(after)[:NEAREST]]
    joined = _JOINED_BEFORE.search(before).group() + " " + _JOINED_AFTER.match(after).group()
    path = [w.lower() for w in _TOKEN.findall(joined) + [w for w in re.split(r"[/.\\]", candidate) if w.isalpha() and "/" in candidate]]
    names = [any(k in w for k in CREDENTIAL_NAMES) for w in near]
    return [
        float(n), counts[0] / n, counts[1] / n, counts[2] / n, counts[3] / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
        float(all(c in "0123456789abcdef" for c in lower)), entropy, covered(candidate, dictionary),
        float("/" in candidate or before[-1:] in ("/", "\\", ".", "@") or after[:1] in ("/", "\\", "@")),
        float(bool(_ASSIGNED.search(before))), float(before[-1:] in ("'", '"') and after[:1] in ("'", '"')),
        float(len(_WORD.findall(before))), float(len(_WORD.findall(after))),
        float(bool(BENIGN_NAMES & (_parts(before) | _parts(after)))), float(any(names)),
        *_indicators([w for w, name in zip(near, names) if not name], WORD_BUCKETS),
        *_indicators([w for w in path if not any(k in w for k in CREDENTIAL_NAMES)], PATH_BUCKETS),
    ]


_SCHEMA = "doc_id long, start int, stop int, digest string, weak int, kind int, features array<double>"


def dictionary_of(docs: DataFrame) -> frozenset[str]:
    """The words of letters that most documents hold, as many whole ranks as fit; words of fewer than LEAST_DOCS are none."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    held = docs.select(F.explode(tokens).alias("word")).where(F.col("word").rlike(rf"^\p{{L}}{{{LETTERS[0]},{LETTERS[1]}}}$"))
    found = written(held.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS))
    size, least = 0, None
    for r in sorted(found.groupBy("n").agg(F.count("*").alias("words")).collect(), reverse=True):
        size += r["words"]
        if size > DICTIONARY:
            break
        least = r["n"]
    return frozenset() if least is None else frozenset(r["word"] for r in found.where(F.col("n") >= least).select("word").collect())


def candidates(docs: DataFrame) -> DataFrame:
    """A row per candidate of whole texts, with its features, offsets in characters, and label by rule (or null) and its kind."""
    dictionary = dictionary_of(docs)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _found(batches, dictionary)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(found, _SCHEMA)


def _found(batches: Iterator[pa.RecordBatch], dictionary: frozenset[str]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        columns: list[list] = [[] for _ in range(7)]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for start, stop, name in spans(text or ""):
                value = text[start:stop]
                features = describe(value, text[max(0, start - CONTEXT) : start], text[stop : stop + CONTEXT], dictionary)
                for column, x in zip(columns, (doc, start, stop, hashlib.sha256(value.encode()).hexdigest()[:16], *rule(value, name, dictionary), features)):
                    column.append(x)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "stop", "digest", "weak", "kind", "features"])


def findings(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, stop, digest, held_out, label, score, kept) of each candidate in ``docs`` (doc_id, text).

    ``labels`` (doc_id, start, label) replaces the labels by rule. The forest
    learns from a seeded, bounded sample of the labelled findings of documents
    whose crc32(doc_id) mod 4 is not 0; the others are held out. Numbers, words and
    named values weigh the same among the labels 0 by rule. With findings of
    one class only, or none, the score is that class's rate (a half for none).
    Null and empty texts have no candidates; repeated rows give repeated
    findings. The candidate itself is not returned, its digest is.
    """
    rows = candidates(docs).withColumnRenamed("weak", "label")
    if labels is not None:
        rows = rows.drop("label").withColumn("kind", F.lit(0)).join(labels.groupBy("doc_id", "start").agg(F.max("label").cast("int").alias("label")), ["doc_id", "start"], "left")
    rows = written(rows.withColumn("held_out", crc_mod(F.col("doc_id"), 4) == 0))
    known = rows.where(~F.col("held_out") & F.col("label").isNotNull())
    counts = {(r["label"], r["kind"]): r["count"] for r in known.groupBy("label", "kind").count().collect()}
    classes = Counter(label for label, _ in counts)
    columns = ["doc_id", "start", "stop", "digest", "held_out", "label"]
    if not classes[0] or not classes[1]:
        rate = 0.5 if not classes else float(bool(classes[1]))
        return rows.select(*columns, F.lit(rate).alias("score"), F.lit(rate >= 0.5).alias("kept"))

    def of_kind(values: dict) -> F.Column:
        return F.coalesce(*[F.when((F.col("label") == label) & (F.col("kind") == kind), F.lit(float(v))) for (label, kind), v in values.items()])

    share = {k: PER_CLASS / n for k, n in counts.items()}
    weight = {k: PER_CLASS / min(PER_CLASS, n) / classes[k[0]] for k, n in counts.items()}
    chosen = known.where(F.pmod(F.xxhash64("doc_id", "start"), F.lit(1_000_000)) / 1_000_000 < of_kind(share)).withColumn("weight", of_kind(weight))
    hidden = [] if labels is not None else [FEATURES.index(f) for f in RULED]
    vector = array_to_vector(F.transform("features", lambda x, i: F.when(i.isin(hidden), 0.0).otherwise(x)) if hidden else F.col("features"))
    # a bounded sample in one ordered partition: the forest's draws are the same in every run
    training = written(chosen.select("label", "weight", "doc_id", "start", vector.alias("features")).coalesce(1).sortWithinPartitions("doc_id", "start"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", labelCol="label", featuresCol="features", weightCol="weight").fit(training)
    scored = forest.transform(rows.withColumn("features", vector)).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select(*columns, "score", (F.col("score") >= 0.5).alias("kept"))

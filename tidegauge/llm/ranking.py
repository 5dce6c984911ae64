"""Ranked lexical search of whole documents for a query set, by Fagin's threshold algorithm on shards.

1. Documents are read once: each becomes a row of the forward index, the query
   terms that it holds with their counts, and its length. Texts go no further.
2. Counts over all documents (with terms at all; their terms; the documents of
   each query term) fix the terms' weights and so every document's impact in every list.
3. A shard is a slice of the forward index in one task. It has an impact-sorted
   list for each query term. A query reads its lists in turn, so many entries
   of each a round; a document that is new is looked up in the forward index, which
   gives its whole score. The threshold is the sum of the impacts last read;
   the query ends when it is strictly below its k-th score, so that no equal
   score with a smaller id is lost.
4. One in PILOT of the documents are searched first. The k-th scores found there
   are true ones of the whole, and every shard starts from them: most shards
   of a large input end after a few rounds. In a task k-th scores go on from shard to shard.
5. The shards' best are ranked in two steps, so that a query's candidates of all shards never meet in one task.

The queries are a stated set that meets all documents, in blocks whose terms hold
about BLOCK_BYTES: a block's vocabulary is what goes to every task, and what the driver sees.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import written

#: Documents that a query gets.
TOP = 50
#: Bytes of a block's query terms, with repeats; documents, and entries, that a shard holds at most.
BLOCK_BYTES, SHARD_DOCS, SHARD_ENTRIES = 8 << 20, 16384, 2_000_000
#: One in so many documents is searched first. Entries of each list that a round reads at first; twice as many in each later round.
PILOT, DEPTH = 64, 32
#: Parts in which a query's candidates are ranked first.
PARTS = 64

#: Terms are runs of these bytes of UTF-8: ASCII letters and digits, and all of characters beyond ASCII.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_FORWARD = "doc_id long, n long, terms array<int>, counts array<long>"
_FOUND = "item long, doc_id long, score long"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode().translate(_TERM_BYTES).split() if text else []


def _forward(vocabulary):
    """Batches of (doc_id, text) to rows of the forward index."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            ids, counts, ends, lengths = [], [], [0], []
            for text in batch.column(1).to_pylist():
                found = Counter(terms(text))
                lengths.append(found.total())
                hits = sorted((number[t], c) for t, c in found.items() if t in number)
                ids += [t for t, _ in hits]
                counts += [c for _, c in hits]
                ends.append(len(ids))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))],
                ["doc_id", "n", "terms", "counts"],
            )

    return indexed


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """The weight of terms that ``df`` of so many documents hold."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What occurrences add to a document's score: whole numbers, rounded down."""
    m = 100 - 50 + (50 * n * documents) // length
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Shard:
    """A slice of the forward index with its impacts, and the impact-sorted list of each term that it holds."""

    def __init__(self, docs: np.ndarray, ends: np.ndarray, ids: np.ndarray, impact: np.ndarray) -> None:
        self.docs, self.ends, self.ids, self.impact = docs, ends, ids, impact
        row = np.repeat(np.arange(len(docs)), np.diff(ends))
        order = np.lexsort((docs[row], -impact, ids))
        self.rows, self.sorted = row[order], impact[order]
        self.terms, starts = np.unique(ids[order], return_index=True)
        self.starts = np.append(starts, len(ids))

    def scores(self, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Random access: the whole scores of documents for the query whose terms ``wanted`` marks."""
        n = self.ends[rows + 1] - self.ends[rows]
        last = np.cumsum(n)
        at = np.arange(last[-1]) + np.repeat(self.ends[rows] - (last - n), n)  # no row that a list holds is without terms
        return np.add.reduceat(np.where(wanted[self.ids[at]], self.impact[at], 0), last - n)

    def search(self, query: np.ndarray, wanted: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(doc_ids, scores, entries read) of the query's k best here that score ``floor`` or more and above 0."""
        place = np.searchsorted(self.terms, query)
        place = place[(place < len(self.terms)) & (self.terms[np.minimum(place, len(self.terms) - 1)] == query)] if len(self.terms) else place[:0]
        start, end = self.starts[place], self.starts[place + 1]
        best, score, seen, depth, read = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self.docs), bool), DEPTH, 0
        while len(start):
            upto = np.minimum(start + depth, end)
            n = upto - start
            at = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
            read += len(at)
            new = np.unique(self.rows[at])
            new = new[~seen[new]]
            seen[new] = True
            if len(new):
                best, score = np.append(best, new), np.append(score, self.scores(new, wanted))
                first = np.lexsort((self.docs[best], -score))[:k]
                best, score = best[first], score[first]
            more = upto < end
            threshold = int(self.sorted[upto[more] - 1].sum())  # of a list that was read to its end nothing is left
            if threshold < max(floor, int(score[-1]) if len(score) == k else 1):
                break
            start, end, depth = upto[more], end[more], depth * 2
        good = score >= max(floor, 1)
        return self.docs[best[good]], score[good], read


def _search(queries, floors, documents: int, length: int, k: int):
    """Batches of the forward index to each query's best of the task."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, asked = queries.value
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        least = dict(floors.value)
        for table in _slices(batches):
            docs, n = table["doc_id"].to_numpy(), table["n"].to_numpy()
            lists, counts = table["terms"].combine_chunks(), table["counts"].combine_chunks()
            ends = lists.offsets.to_numpy().astype(np.int64)
            ids, tf = lists.values.to_numpy()[ends[0] : ends[-1]], counts.values.to_numpy()[ends[0] : ends[-1]]
            shard = Shard(docs, ends - ends[0], ids, impacts(weight[ids], tf, np.repeat(n, np.diff(ends)), documents, length))
            wanted = np.zeros(len(weight), bool)
            for item, query in asked.items():
                wanted[query] = True
                doc, score, _ = shard.search(query, wanted, least.get(item, 1), k)
                wanted[query] = False
                if len(doc):
                    doc, score = (np.concatenate(x) for x in zip(kept.get(item, (doc[:0], score[:0])), (doc, score)))
                    first = np.lexsort((doc, -score))[:k]
                    kept[item] = doc[first], score[first]
                    if len(first) == k:
                        least[item] = max(least.get(item, 1), int(score[first[-1]]))
        for item, (doc, score) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), item)), pa.array(doc), pa.array(score)], ["item", "doc_id", "score"])

    return searched


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    docs = entries = 0
    for batch in batches:
        held.append(batch)
        docs, entries = docs + batch.num_rows, entries + len(batch.column(2).values)
        if docs >= SHARD_DOCS or entries >= SHARD_ENTRIES:
            yield pa.Table.from_batches(held)
            held, docs, entries = [], 0, 0
    if docs:
        yield pa.Table.from_batches(held)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item, with their rank, first in parts."""
    best = [F.desc("score"), F.asc("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    inside = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*best))).where(F.col("rank") <= k)
    return inside.drop("part", "rank").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= k)


def _block(docs: DataFrame, items: dict[int, list[bytes]], k: int) -> DataFrame:
    """(item, rank, doc_id, score) of a block of queries; ``items`` has each one's distinct terms."""
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    names = sorted({t for found in items.values() for t in found})
    number = {t: i for i, t in enumerate(names)}
    forward = written(docs.mapInArrow(_forward(context.broadcast(number)), _FORWARD).where("n > 0"))
    totals = forward.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
    if not totals.documents:
        return spark.createDataFrame([], "item long, doc_id long, score long, rank int")
    df = np.zeros(len(names), np.int64)
    for row in forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row per query term at most
        df[row["term"]] = row["count"]
    weight = weights(df, totals.documents)
    asked = {item: np.array(sorted(number[t] for t in found), np.int64) for item, found in items.items()}
    shared = context.broadcast((weight, {item: q[weight[q] > 0] for item, q in asked.items()}))

    def search(rows: DataFrame, floors: dict[int, int]) -> DataFrame:
        return rows.mapInArrow(_search(shared, context.broadcast(floors), totals.documents, totals.length, k), _FOUND)

    pilot = _ranked(search(forward.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(PILOT)) == 0), {}), k)
    floors = {r["item"]: r["score"] for r in pilot.where(F.col("rank") == k).collect()}  # a row per query of the block at most
    return _ranked(search(forward, floors), k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each item, equal scores by ascending doc_id.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are
    ignored. Terms are runs of ASCII letters and digits and of characters beyond
    ASCII, with only A-Z lower-cased; null and empty texts have none. Documents
    without terms aren't counted. Rows without doc_id are no documents, and rows
    without item_id no items. Rows that repeat a doc_id are documents of their
    own; rows that repeat an item_id are one item with all their terms, each
    once. Items that no document scores for, and empty tables, give no rows.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for number in range(blocks):  # one, unless there are very many items
        wanted: dict[int, set[bytes]] = {}
        for row in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).toLocalIterator():
            wanted.setdefault(row.item_id, set()).update(terms(row.text))
        found = _block(docs, {item: sorted(t) for item, t in wanted.items() if t}, k)
        out = out.unionByName(found.select(F.col("item").alias("item_id"), "rank", "doc_id", "score"))
    return out


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
with w as (select doc_id, regexp_extract_all({_LOWERED.format("text")}, '{_TERM}') as t from documents where doc_id is not null),
d as (select row_number() over () as r, doc_id, t, len(t)::hugeint as n from w where len(t) > 0),
total as (select count(*)::hugeint as docs, sum(n)::hugeint as terms from d),
i as (select distinct item_id, unnest(regexp_extract_all({_LOWERED.format("text")}, '{_TERM}')) as term from benchmark where item_id is not null),
tf as (select r, doc_id, n, term, count(*)::hugeint as tf from (select r, doc_id, n, unnest(t) as term from d) where term in (select term from i) group by all),
df as (select term, count(*) as df from tf group by term),
s as (select item_id, r, doc_id, sum(floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::bigint as score
  from i join tf using (term) join df using (term) cross join total group by item_id, r, doc_id)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from s where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= {TOP}
"""

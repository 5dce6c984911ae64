"""Benchmark items inside long documents: size-partitioned MinHash containment, verified exactly.

The Jaccard similarity of a short item and a long document says nothing, so the
search is by containment. Items are partitioned by size, in powers of two; an
item's sketch is its ``k`` least shingle hashes (bottom-k MinHash) with ``k`` one
more than the shingles that an item of its partition's upper size may lack. A
document that holds three quarters of the item must then hold a shingle of the
sketch: the search misses nothing, and reads of a partition's items only what
its size asks for. Documents are never shuffled in the search; their shingle
hashes probe the sketches, which are broadcast up to BROADCAST_HASHES and
joined by hash beyond. Candidates are verified by exact containment of the
shingles themselves.

Only DataFrame functions are used. Words are lower-cased (A-Z) runs of characters
other than ASCII white space. Shingles are runs of five words; a text of one to
four words is its only shingle, so that such an item is found only in documents
with the same words and no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import WORD, written

WIDTH, PERCENT = 5, 75
#: Sketch hashes (16 bytes each) up to which they are broadcast.
BROADCAST_HASHES = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _of_words(text: Column, made) -> Column:
    """``made`` of the text's words, which a lambda's variable holds: Spark would else find them anew for every run."""
    return F.get(F.transform(F.array(words(text)), made), F.lit(0))


def _hashes(w: Column) -> Column:
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - WIDTH, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WIDTH)]))
    return F.when(F.size(w) > 0, runs).otherwise(F.expr("cast(array() as array<bigint>)"))


def shingle_hashes(text: Column) -> Column:
    """Hashes of the runs of five words of a text, with repeats; of all its words if it has fewer."""
    return _of_words(text, _hashes)


def _texts(w: Column) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - WIDTH + 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(w, i, WIDTH)))
    return F.when(F.size(w) > 0, runs).otherwise(F.expr("cast(array() as array<string>)"))


def shingle_texts(text: Column) -> Column:
    """The runs of five words as strings, with repeats; all words of a text that has fewer."""
    return _of_words(text, _texts)


def sketches(items: DataFrame) -> DataFrame:
    """(item_id, hash) of the bottom-k sketches; k depends on the item's size partition only."""
    hashed = items.select("item_id", F.array_sort(F.array_distinct(shingle_hashes(F.col("text")))).alias("h")).where("item_id is not null and size(h) > 0")
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.size("h"))))
    k = F.floor(upper * (100 - PERCENT) / 100).cast("int") + 1
    return hashed.select("item_id", F.explode(F.slice("h", F.lit(1), k)).alias("hash"))


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of documents that share a sketch hash with an item, as a written table."""
    sketch = written(sketches(items))
    if sketch.count() <= BROADCAST_HASHES:
        sketch = F.broadcast(sketch)
    probes = docs.where("doc_id is not null").select("doc_id", F.explode(shingle_hashes(F.col("text"))).alias("hash"))
    return written(probes.join(sketch, "hash").select("doc_id", "item_id").distinct())


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of all pairs with 100 * n_shared >= 75 * n_item.

    ``docs`` has doc_id and text, ``items`` item_id and text. Null texts count as
    empty and empty texts have no shingles, so they are in no pair; rows without
    id are in none either. Repeated rows give one pair; of distinct texts under
    one id the best containment counts. Other columns are ignored.
    """
    pairs = candidates(docs, items)
    texts = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
    found = written(pairs.join(texts, "doc_id").select("doc_id", "item_id", shingle_texts(F.col("text")).alias("s")).join(
        items.select("item_id", F.array_distinct(shingle_texts(F.col("text"))).alias("t")), "item_id"
    ).select("doc_id", "item_id", F.size("t").alias("n_item"), F.size(F.array_intersect("s", "t")).alias("n_shared")))
    best = found.where(F.lit(100) * F.col("n_shared") >= F.lit(PERCENT) * F.col("n_item")).groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_item", "n_shared")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.n_item").alias("n_item"), F.col("best.n_shared").alias("n_shared"), F.col("best.containment").alias("containment"))


def without_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns. Rows without doc_id are known by their text here."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # as one column: no name of theirs can clash
    key = F.coalesce(F.concat(F.lit("id "), F.col("doc_id").cast("string")), F.concat(F.lit("text "), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    found = contained(docs.select(key.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("_key")).distinct()
    return docs.select(row.alias("_row"), key.alias("_key")).join(found, "_key", "left_anti").select("_row.*")


ORACLE = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents where doc_id is not null),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from benchmark where item_id is not null),
ds as (select distinct doc_id, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, greatest(len(w) - 4, 1) + 1)]) as s from dw where len(w) > 0),
i_s as (select distinct item_id, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, greatest(len(w) - 4, 1) + 1)]) as s from iw where len(w) > 0),
n as (select item_id, count(*) as n_item from i_s group by item_id),
m as (select doc_id, item_id, count(*) as n_shared from ds join i_s using (s) group by doc_id, item_id)
select doc_id, item_id, cast(n_item as integer) as n_item, cast(n_shared as integer) as n_shared, n_shared / n_item::double as containment
from m join n using (item_id) where 100 * n_shared >= 75 * n_item
"""

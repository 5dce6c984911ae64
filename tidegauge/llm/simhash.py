"""SimHash fingerprints of whole texts, and all fingerprints within 4 bits by a byte-position inverted index.

1. Every text becomes the 64-bit fingerprint of its runs of four words. Equal
   fingerprints are one node from then on, so that copies cost one row.
2. A fingerprint is eight bytes at eight positions. Two that differ in 4 bits or
   fewer share at least ``8 - 4`` positional bytes: the least number of matches.
   Each of the lists of the index stands for three positions and their bytes;
   the 20 triples of ``TRIPLES`` are such that any four positions contain one, so
   that every pair that reaches the count meets in a list, of 2**24 a triple.
3. In a list the shared positional bytes of a pair are counted, pairs that
   reach the least number are kept, and verified by the bits that differ. First
   each list's members are held against its least fingerprint (row by row, no
   matter how long the list is); only lists that still hold several groups
   go on, in blocks, and members of a list's largest group don't meet again.
4. Components of the links give every row its component.

All steps are exact. Not linear: fingerprints of a list that are near in three
bytes, but linked with none of the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import grouped, written
from tidegauge.llm.components import components
from tidegauge.llm.dedup import blocked, spanning
from tidegauge.llm.shingles import SPACE, slices, word_spans

#: Words of a shingle; seed of its digest; bits that linked fingerprints differ in at most; positional bytes they share at least.
WIDTH, SEED, BITS = 4, 42, 4
SHARED = 8 - BITS
#: Members of a list that a block holds on average.
BLOCK = 2048
#: Digests whose bits are summed together.
_CHUNK = 1 << 15


def _triples() -> list[tuple[int, int, int]]:
    """Triples of eight positions of which any four positions contain one: the positions lie in three
    classes in a circle, and triples have all in a class, or two in it and one in the next."""
    classes = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [c for c in classes if len(c) == 3]
    for k, c in enumerate(classes):
        out += [tuple(sorted((*pair, one))) for pair in combinations(c, 2) for one in classes[(k + 1) % 3]]
    return out


TRIPLES = _triples()
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(digests: np.ndarray) -> int:
    """The bits that are set in over half of the digests."""
    if not len(digests):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(digests), _CHUNK):
        part = digests[at : at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(digests)).tobytes(), "big")


def _single_spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words, lower-cased, with one space after each; and where they start and end there."""
    joined = np.append(data, np.uint8(32))
    kept = ~SPACE[joined]
    kept[ends], joined[ends] = True, 32
    last = np.cumsum(ends - starts + 1) - 1
    return joined[kept].tobytes().translate(_LOWER), last - (ends - starts), last


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        out = []
        for _, data, offsets in slices(batch.column(1)):
            starts, ends, rows = word_spans(data, offsets)
            for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
                if a == b:
                    out.append(0)
                    continue
                base = starts[a]
                text, first, last = _single_spaced(data[base : ends[b - 1]], starts[a:b] - base, ends[a:b] - base)
                width = min(WIDTH, b - a)
                spans = zip(first[: b - a - width + 1].tolist(), last[width - 1 :].tolist())
                out.append(fingerprint(np.fromiter((digest(text[s:e], SEED) for s, e in spans), np.uint64, b - a - width + 1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row of ``docs`` (doc_id, text): the fingerprint's 64 bits as a long; 0 for texts without words, and null ones."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def _list(fp: Column, number: int, positions: tuple[int, int, int]) -> Column:
    """The list of the index that holds a fingerprint for these positions: the triple's number and the three bytes."""
    bytes_ = [F.shiftleft(_byte(fp, p), 8 * k) for k, p in enumerate(positions)]
    return F.lit(number << 24).cast("long").bitwiseOR(bytes_[0]).bitwiseOR(bytes_[1]).bitwiseOR(bytes_[2])


def postings(nodes: DataFrame) -> DataFrame:
    """(list, node) of the inverted index over ``nodes`` (node: a fingerprint)."""
    return nodes.select("node", F.explode(F.array(*[_list(F.col("node"), k, p) for k, p in enumerate(TRIPLES)])).alias("list"))


def shared_bytes(a: Column, b: Column) -> Column:
    """How many positional bytes two fingerprints share."""
    apart = a.bitwiseXOR(b)
    return sum(((_byte(apart, p) == 0).cast("int") for p in range(1, 8)), (_byte(apart, 0) == 0).cast("int"))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the groups of two blocks of a list, as many as connect them."""
    for table, cuts in grouped(batches, ["list", "p", "q"]):
        nodes, heads = table["node"].to_numpy(), table["head"].to_numpy()
        found = []
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if e - s < 2 or (heads[s:e] == heads[s]).all():
                continue
            bits, group, slab = nodes[s:e].view(np.uint64), np.unique(heads[s:e], return_inverse=True)[1], max(1, _CHUNK // (e - s))
            left, right = [], []
            for r in range(0, e - s, slab):  # a slab of rows against all rows after its first
                apart = bits[r : r + slab, None] ^ bits[None, r:]
                tally = (apart.view(np.uint8).reshape(*apart.shape, 8) == 0).sum(2, dtype=np.int8)
                x, y = np.nonzero((tally >= SHARED) & (group[r : r + slab, None] != group[None, r:]))
                near = np.bitwise_count(apart[x, y]) <= BITS
                left.append(r + x[near])
                right.append(r + y[near])
            left, right = np.concatenate(left), np.concatenate(right)
            chosen = spanning(int(group.max()) + 1, group[left], group[right])
            found.append((nodes[s:e][left[chosen]], nodes[s:e][right[chosen]]))
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all of ``nodes`` (node: distinct fingerprints) that differ in 4 bits or fewer.

    Not every pair: of groups of a list that links connect already, no more than that.
    """
    spread = written(postings(nodes))
    lists = spread.groupBy("list").agg(F.count("*").alias("members"), F.min("node").alias("hub")).where("members > 1")
    spread = written(spread.join(lists.select("list", "hub"), "list"))
    apart = F.col("node").bitwiseXOR(F.col("hub"))
    stars = spread.where((F.col("node") != F.col("hub")) & (shared_bytes(F.col("node"), F.col("hub")) >= SHARED) & (F.bit_count(apart) <= BITS))
    stars = written(stars.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    heads = components(stars).select("node", F.col("component").alias("head"))
    members = spread.select("list", "node").join(heads, "node", "left").withColumn("head", F.coalesce("head", "node"))
    mixed = members.groupBy("list").agg(F.min("head").alias("x"), F.max("head").alias("y")).where("x <> y").select("list")
    members = written(members.join(mixed, "list", "left_semi"))
    blocks = blocked(members, "list", F.lit(0), block).select("list", "p", "q", "node", "head")
    between = blocks.repartition("list", "p", "q").sortWithinPartitions("list", "p", "q", "node").mapInArrow(_near, "a long, b long")
    return stars.unionByName(between)


def near_fingerprints(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs`` (doc_id long, text string).

    Two rows are linked if their fingerprints differ in 4 bits or fewer;
    ``component_id`` is the least doc_id that is reachable. Texts without words,
    and null ones, have fingerprint zero and are linked like any other. Rows
    without doc_id get a fingerprint, take no part in links and have no
    component. Rows that repeat a doc_id are one document and linked. Other
    columns are ignored; an empty table gives an empty one.
    """
    table = written(fingerprints(docs))
    named = table.where("doc_id is not null")
    owners = written(named.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = links(owners.select(F.col("fp").alias("node")), block)
    several = named.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("doc_id", "a")
    same = named.join(several, "doc_id").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    heads = components(found.unionByName(same)).select(F.col("node").alias("fp"), "component")
    owners = owners.join(heads, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named_by = owners.groupBy("component").agg(F.min("least").alias("component_id"))
    owners = owners.join(named_by, "component").select("fp", "component_id")
    rows = table.join(owners, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"))

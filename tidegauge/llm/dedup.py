"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

1. Every whole text becomes its shingle set, the set a fingerprint of 128 bits,
   a sketch and band hashes. Equal sets are one node from then on (a combined
   aggregation), so large groups of copies cost one row each.
2. In every band bucket the least node is the representative. The other members
   are held against it, by sketch and then exactly: a large group of near copies
   is linked in as many comparisons as it has members.
3. Only buckets that still hold several groups go on. Their members of different
   groups are compared by sketch, in blocks; members of a bucket's largest group
   meet those of the others only. Nodes with a candidate in another group meet it
   again in the same way, now with their full sets.
4. Components of the links give every row its component.

A pair at the threshold shares no band with probability 5e-6 and fails the
sketch comparison with less than 1e-6; everything else is exact. No task gets
more than two blocks, whatever the group's size. What is not linear is the number
of nodes that have candidates in many other groups: texts that share between
a half and three quarters of their shingles with very many others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import WORD, grouped, written
from tidegauge.llm.components import components
from tidegauge.llm.shingles import U64, list_array, mix, shingle_sets
from tidegauge.llm.sketches import BINS, bands, sketches

#: Least similarity of a link, in percent.
PERCENT = 75
#: Agreeing bins of 128 below which a pair isn't looked at: five deviations under 0.75.
AGREE = 71
#: Nodes, and shingles, that a block holds on average.
BLOCK_NODES, BLOCK_SHINGLES = 256, 400_000
#: Members of a bucket that are held against one copy of its representative, on average.
MEMBERS = 512

_SETS = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch binary"


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = list(shingle_sets(part.column(1)))
            values = sketches(sets)
            n = np.array([len(s) for s in sets], np.int64)
            with np.errstate(over="ignore"):
                f1 = np.array([mix(s).sum(dtype=U64) for s in sets], U64).view(np.int64)
                f2 = np.array([mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64) for s in sets], U64).view(np.int64)
            short = [b if k else b[:0] for b, k in zip(bands(values).view(np.int64), n)]
            low = (mix(values) & U64(255)).astype(np.uint8)  # one byte of each bin is enough to compare
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n), pa.array(f1), pa.array(f2), list_array(short, pa.int64()), pa.array([x.tobytes() for x in low], pa.binary())],
                ["doc_id", "n_shingles", "f1", "f2", "bands", "sketch"],
            )


def sketch_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, bands, sketch) of each row of ``docs`` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sketched, _SETS)


def blocked(members: DataFrame, key: str, mass: F.Column, most: int | None = None) -> DataFrame:
    """Rows (key, p, q) for each pair of blocks in which members of different groups of a key can meet.

    ``members`` has ``key``, node and head, the node's group. Blocks have about
    ``most`` (BLOCK_NODES) members and BLOCK_SHINGLES of ``mass``. The key's largest group
    (the core) has blocks of its own, which don't meet one another.
    """
    groups = members.groupBy(key, "head").agg(F.count("*").alias("n"), F.sum(mass).alias("m"))
    sizes = groups.groupBy(key).agg(F.max(F.struct("n", "m", "head")).alias("core"), F.sum("n").alias("n"), F.sum("m").alias("m"))
    blocks = lambda n, m: F.greatest(F.ceil(n / (most or BLOCK_NODES)), F.ceil(m / BLOCK_SHINGLES), F.lit(1)).cast("long")
    sizes = sizes.select(key, F.col("core.head").alias("_core"), blocks(F.col("core.n"), F.col("core.m")).alias("_cores"), blocks(F.col("n") - F.col("core.n"), F.col("m") - F.col("core.m")).alias("_others"))
    dealt = members.join(sizes, key).withColumn("_in", F.col("head") == F.col("_core"))
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("_in"), F.col("_cores")).otherwise(F.col("_others"))) + F.when(F.col("_in"), F.col("_others")).otherwise(0)
    last = F.when(F.col("_in"), F.col("_others")).otherwise(F.col("_others") + F.col("_cores")) - 1
    dealt = dealt.withColumn("_b", own).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return dealt.withColumn("p", F.least("_b", "_o")).withColumn("q", F.greatest("_b", "_o")).drop("_core", "_cores", "_others", "_in", "_b", "_o")


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> list[int]:
    """Places of the edges of a spanning forest of a graph on 0..n-1."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            out.append(k)
    return out


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least number that each of 0..n-1 is connected with."""
    found = np.arange(n)
    while True:
        before = found.copy()
        np.minimum.at(found, left, found[right])
        np.minimum.at(found, right, found[left])
        found = found[found]
        if (found == before).all():
            return found


def _edges(nodes: np.ndarray, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T if pairs else (np.zeros(0, np.int64),) * 2
    return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, left, right, salt) whose sketches agree enough."""
    for batch in batches:
        if batch.num_rows:
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (2, 3))
            yield batch.filter(pa.array((left == right).sum(1) >= AGREE)).select([0, 1, 4])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, head, root) of the nodes with a candidate in another group; root: the least head that candidates reach in the block."""
    for table, cuts in grouped(batches, ["bh", "p", "q"]):
        nodes, size, heads = (table[c].to_numpy() for c in ("node", "n_shingles", "head"))
        flat = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for s, e in zip(cuts[:-1], cuts[1:]):
            x, n, h = flat[s:e], size[s:e], heads[s:e]
            if e - s < 2 or (h == h[0]).all():
                continue
            agree = h[:, None] != h
            agree &= 100 * np.minimum(n[:, None], n) >= PERCENT * np.maximum(n[:, None], n)
            for r in range(0, e - s, 64):
                agree[r : r + 64] &= (x[r : r + 64, None, :] == x[None, :, :]).sum(2) >= AGREE
            left, right = np.nonzero(agree)
            if not len(left):
                continue
            names, group = np.unique(h, return_inverse=True)  # in ascending order: a root's least group is its least head
            root = _roots(len(names), group[left], group[right])
            hit = np.unique(left)
            out.append((s + hit, names[root[group[hit]]]))
        at = np.concatenate([a for a, _ in out]) if out else np.zeros(0, np.int64)
        root = np.concatenate([r for _, r in out]) if out else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(heads[at]), pa.array(root)], ["node", "head", "root"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links, from full sets, that connect the nodes' groups as all links of a block do."""
    for table, cuts in grouped(batches, ["cluster", "p", "q"]):
        nodes, heads = table["node"].to_numpy(), table["head"].to_numpy()
        lists = table["shingles"].combine_chunks()
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        for s, e in zip(cuts[:-1], cuts[1:]):
            if e - s < 2 or (heads[s:e] == heads[s]).all():
                continue
            local, own = np.unique(values[ends[s] : ends[e]], return_inverse=True)
            off, group = ends[s : e + 1] - ends[s], np.unique(heads[s:e], return_inverse=True)[1]
            n, marked, pairs = np.diff(off), np.zeros(len(local), bool), []
            for r in range(e - s - 1):  # rows after r against row r
                mine = own[off[r] : off[r + 1]]
                marked[mine] = True
                later = np.add.reduceat(marked[own[off[r + 1] :]].astype(np.int32), off[r + 1 : -1] - off[r + 1])
                marked[mine] = False
                hit = np.flatnonzero((100 * later.astype(np.int64) >= PERCENT * (n[r] + n[r + 1 :] - later)) & (group[r + 1 :] != group[r]))
                pairs += [(r, r + 1 + y) for y in hit.tolist()]
            left, right = np.array(pairs, np.int64).reshape(-1, 2).T if pairs else (np.zeros(0, np.int64),) * 2
            chosen = spanning(int(group.max()) + 1, group[left], group[right])
            yield _edges(nodes[s:e], [pairs[k] for k in chosen])


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), list_array(list(shingle_sets(part.column(1))), pa.int64())], ["node", "shingles"])


def _full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles): the whole set of each of ``nodes`` (node)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    # the nodes grow with the input, so that a broadcast would only do for small ones; rows that repeat count once
    chosen = texts.join(nodes.distinct().hint("merge"), "node", "left_semi").dropDuplicates(["node", "text"])
    # a node's doc_id may have several texts: their sets count as the node's
    return written(chosen.mapInArrow(_with_sets, "node long, shingles array<long>").where(F.size("shingles") > 0))


def _dealt(stars: DataFrame) -> DataFrame:
    """``stars`` (a, b) with ``salt``: the members of a hub b in parts of about MEMBERS each."""
    parts = F.ceil(F.col("count") / MEMBERS).cast("long")
    sizes = stars.groupBy("b").count().select("b", parts.alias("_parts"))
    return stars.join(sizes, "b").select("a", "b", F.pmod(F.xxhash64("a", F.lit(3)), F.col("_parts")).alias("salt"))


def _with_hubs(stars: DataFrame, rows: DataFrame) -> DataFrame:
    """``stars`` (a, b, salt, ...) joined with ``rows`` (b, ...), of which each part of a hub's members gets a copy."""
    hubs = stars.select("b", "salt").distinct().join(rows, "b")
    return stars.join(hubs, ["b", "salt"])


def _to_representatives(sets: DataFrame, kept: DataFrame, spread: DataFrame) -> DataFrame:
    """Links (a, b) between the representative (hub) of each bucket and its other members.

    A hub of very many members never meets them in one task: it is copied once for every MEMBERS of them.
    """
    stars = written(_dealt(written(spread.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())))
    sketched = kept.select("node", "n_shingles", "sketch")
    both = _with_hubs(stars.join(sketched.toDF("a", "na", "left"), "a"), sketched.toDF("b", "nb", "right")).where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    pairs = written(both.select("a", "b", "left", "right", "salt").mapInArrow(_agreeing, "a long, b long, salt long"))
    both = _with_hubs(pairs.join(sets.toDF("a", "left"), "a"), sets.toDF("b", "right"))
    both = both.withColumn("shared", F.size(F.array_intersect("left", "right")))
    return both.where(100 * F.col("shared") >= PERCENT * (F.size("left") + F.size("right") - F.col("shared"))).select("a", "b")


def _between_groups(sets: DataFrame, kept: DataFrame, spread: DataFrame, heads: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of different groups (``heads``: node, head; a node that isn't there is a group)."""
    members = spread.join(heads, "node", "left").withColumn("head", F.coalesce("head", "node"))
    mixed = members.groupBy("bh").agg(F.min("head").alias("x"), F.max("head").alias("y")).where("x <> y").select("bh")
    members = written(members.join(mixed, "bh", "left_semi"))
    members = members.join(kept.select("node", "n_shingles", "sketch"), "node")
    blocks = blocked(members, "bh", F.lit(0)).select("bh", "p", "q", "node", "head", "n_shingles", "sketch")
    near = written(blocks.repartition("bh", "p", "q").sortWithinPartitions("bh", "p", "q", "node").mapInArrow(_near, "node long, head long, root long"))
    clusters = components(near.select(F.col("head").alias("a"), F.col("root").alias("b")))
    touched = near.select("node", "head").distinct().join(clusters.select(F.col("node").alias("head"), F.col("component").alias("cluster")), "head")
    touched = written(touched.join(sets, "node"))
    meet = blocked(touched, "cluster", F.size("shingles")).select("cluster", "p", "q", "node", "head", "shingles")
    return meet.repartition("cluster", "p", "q").sortWithinPartitions("cluster", "p", "q", "node").mapInArrow(_linked, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id long, text string).

    Two rows are linked if 100 * intersection >= 75 * union of their shingle
    sets; ``component_id`` is the least doc_id that is reachable and ``kept``
    says that it is the row's own. Rows without words have an empty set and are
    linked with nothing. Rows without doc_id take no part: component_id null,
    kept true. Rows that repeat a doc_id are one document: those with words are
    linked, whatever their texts. Other columns are ignored.
    """
    table = written(sketch_table(docs))
    named = table.where("doc_id is not null and n_shingles > 0")
    nodes = written(named.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("node")))
    own = nodes.select("f1", "f2", "n_shingles", F.col("node").alias("doc_id"))
    key = ["f1", "f2", "n_shingles", "doc_id"]
    kept = named.join(own, key, "left_semi").dropDuplicates(key)  # repeated rows have equal sketches
    kept = written(kept.select(F.col("doc_id").alias("node"), "n_shingles", "bands", "sketch"))

    spread = kept.select("node", F.explode("bands").alias("bh"))
    buckets = spread.groupBy("bh").agg(F.count("*").alias("members"), F.min("node").alias("hub")).where("members > 1")
    spread = written(spread.join(buckets.select("bh", "hub"), "bh"))
    sets = _full_sets(docs, spread.select("node"))
    links = written(_to_representatives(sets, kept, spread))
    first = written(components(links))
    links = links.unionByName(_between_groups(sets, kept, spread.select("node", "bh"), first.select("node", F.col("component").alias("head"))))

    many = named.select("doc_id", F.struct("f1", "f2", "n_shingles").alias("s")).groupBy("doc_id").agg(F.min("s").alias("x"), F.max("s").alias("y")).where("x <> y")
    again = named.join(many.select("doc_id"), "doc_id", "left_semi").select("doc_id", "f1", "f2", "n_shingles").join(nodes, ["f1", "f2", "n_shingles"])
    links = links.unionByName(again.select(F.col("node").alias("a"), F.col("doc_id").alias("b")))
    found = components(links).select("node", F.col("component").alias("root"))

    heads = nodes.join(found, "node", "left").select("f1", "f2", "n_shingles", F.coalesce("root", "node").alias("head"))
    rows = table.select("doc_id", "n_shingles", "f1", "f2").join(heads, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("head"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, those that repeat both doc_id and text once; and those without doc_id.

    Rows without words of a document whose other rows go stay: they are linked with nothing.
    """
    words = F.coalesce(F.regexp_like(F.col("text").cast("string"), F.lit(WORD)), F.lit(False))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # as one column: no name of theirs can clash
    marked = docs.select(row.alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_text"), words.alias("_words"))
    gone = written(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_doc")).distinct())
    repeated = written(marked.where("_doc is not null").groupBy("_doc", "_text").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    stay = marked.join(gone.withColumn("_words", F.lit(True)), ["_doc", "_words"], "left_anti")
    once = stay.join(repeated, ["_doc", "_text"], "left_semi").dropDuplicates(["_doc", "_text"])
    return stay.join(repeated, ["_doc", "_text"], "left_anti").select("_row").unionByName(once.select("_row")).select("_row.*")

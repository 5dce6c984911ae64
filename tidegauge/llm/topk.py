"""Exact top-k by integer inner product, with one KD-tree per shard.

Shards are cells of space: median splits fitted on a bounded sample deal all
vectors, and cells of many vectors (also equal ones) are dealt on by a hash of
the id. A shard's tree is built once, by median splits along the widest side,
with tight bounding boxes at all nodes, and written. A query first goes to the
shard whose box promises most, which gives it a k-th score; after that it only
goes to shards whose box still reaches that score. In a shard every query
goes through the tree best first, by the bound ``sum(max(q * low, q * high))``
of the boxes of inner nodes and leaves, and ends where the best bound that is
left doesn't reach its k-th score.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import written

#: Components are floor(SCALE * x).
SCALE = 256
#: Vectors of a leaf at most; vectors of a shard on average at most; cells at least and at most.
LEAF, SHARD, CELLS = 256, 8192, (16, 1024)
#: Components of the sample that cells are fitted on, at most.
SAMPLE = 1 << 21
#: Queries that meet a shard in one task on average at most, and that go through a tree together.
BLOCK, TOGETHER = 16384, 2048
#: Shards, and queries, whose bounds are computed in one task, on average at most.
BOXES, ROUTED = 2048, 4096
_NONE = -(2**63)


class Tree:
    """Nodes in order of creation: the rows of ``order`` that each holds, its first child (the other one follows; 0 for a leaf), its box."""

    @staticmethod
    def of(child: np.ndarray, spans: np.ndarray, low: np.ndarray, high: np.ndarray) -> "Tree":
        """A tree that was built before, over rows in its order."""
        tree = object.__new__(Tree)
        tree.child, tree.spans, tree.low, tree.high = child, spans, low, high
        tree.order = np.arange(spans[0, 1])
        return tree

    def __init__(self, vectors: np.ndarray, leaf: int | None = None) -> None:
        leaf = leaf or LEAF
        self.order = np.arange(len(vectors))
        spans, self.child = [(0, len(vectors))], [0]
        low, high = [], []
        for node, (a, b) in enumerate(spans):
            mine = vectors[self.order[a:b]]
            low.append(mine.min(0))
            high.append(mine.max(0))
            if b - a <= leaf:
                continue
            side, middle = int(np.argmax(high[-1] - low[-1])), (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(mine[:, side], middle)]
            self.child[node] = len(spans)
            spans += [(a, a + middle), (a + middle, b)]
            self.child += [0, 0]
        self.child, self.spans = np.array(self.child), np.array(spans)
        self.low, self.high = np.array(low), np.array(high)


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest inner product that each query can have in each box."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def _exact(*parts: np.ndarray) -> type:
    """The kind of numbers in which inner products of vectors of these arrays are exact: below 2**53, or in 64 bits."""
    reach = [max(1, *(abs(int(x)) for x in (p.min(), p.max()))) if p.size else 1 for p in parts]
    return np.float64 if reduce(lambda a, b: a * b, reach) * parts[0].shape[1] < 2**53 else np.int64


def search(tree: Tree, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Per query the ids and scores of the k best, ties to the lesser id, and how many leaves were opened in all.

    Unfilled places have the score _NONE. ``kth``: scores that are already known
    to be reached k times; worse ones may be left out. Queries move in step: each
    opens its own best node, and those that open the same node do so together.
    """
    n = len(queries)
    ids_best = np.full((n, k), np.iinfo(np.int64).max)
    best = np.full((n, k), _NONE, queries.dtype)
    shut = -np.inf if queries.dtype == np.float64 else _NONE
    open_ = np.full((n, len(tree.child)), shut, queries.dtype)
    open_[:, 0] = bounds(queries, tree.low[:1], tree.high[:1])[:, 0]
    active, opened = np.arange(n), 0
    while len(active):
        node = open_[active].argmax(1)
        left = open_[active, node]
        go = (left > shut) & (left >= np.maximum(kth[active], best[active, -1]))
        active, node = active[go], node[go]
        open_[active, node] = shut
        by = np.argsort(node, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(node[by])) + 1, [len(by)]]) if len(by) else np.zeros(1, int)
        for s, e in zip(cuts[:-1], cuts[1:]):
            asks, at = active[by[s:e]], int(node[by[s]])
            first = tree.child[at]
            if first:
                open_[asks, first : first + 2] = bounds(queries[asks], tree.low[first : first + 2], tree.high[first : first + 2])
                continue
            opened += len(asks)
            rows = tree.order[slice(*tree.spans[at])]
            scores = queries[asks] @ vectors[rows].T
            scores[own[asks][:, None] == ids[rows][None, :]] = _NONE
            some = (scores >= np.maximum(kth[asks], best[asks, -1])[:, None]).any(1)
            if not some.any():
                continue
            asks, scores = asks[some], scores[some]
            all_scores = np.concatenate([best[asks], scores], 1)
            all_ids = np.concatenate([ids_best[asks], np.broadcast_to(ids[rows], scores.shape)], 1)
            order = np.lexsort((all_ids, -all_scores if all_scores.dtype == np.float64 else ~all_scores), axis=1)[:, :k]
            best[asks], ids_best[asks] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)
    return ids_best, best, opened


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.int64)


def _cells(points: DataFrame, count: int) -> tuple[int, list]:
    """The dimension of most sampled vectors, and median splits of their space: (side, value, lower, upper) or a cell's number."""
    dims = points.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return 0, [0]
    share = min(1.0, SAMPLE / dims["dim"] / dims["count"])
    some = points.where(F.col("dim") == dims["dim"]).where(F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(1_000_000)) < F.lit(share * 1_000_000))
    sample = some.select("v").toPandas()["v"]
    if not len(sample):
        return dims["dim"], [0]
    vectors, splits, cells = _stacked(sample), [None], 0
    todo = [(0, np.arange(len(vectors)), count)]
    for place, rows, parts in todo:
        mine = vectors[rows]
        side = int(np.argmax(mine.max(0) - mine.min(0))) if len(rows) else 0
        value = int(np.median(mine[:, side])) if len(rows) else 0
        upper = mine[:, side] > value
        if parts < 2 or not upper.any() or upper.all():
            splits[place], cells = cells, cells + 1
            continue
        splits[place] = (side, value, len(splits), len(splits) + 1)
        todo += [(len(splits), rows[~upper], parts - parts // 2), (len(splits) + 1, rows[upper], parts // 2)]
        splits += [None, None]
    return dims["dim"], splits


def _dealt(points: DataFrame, dim: int, splits: list) -> DataFrame:
    """``points`` with their cells; vectors of other dimensions than ``dim`` are all in cell 0."""

    def deal(frames):
        for frame in frames:
            cell = np.zeros(len(frame), np.int64)
            rows = np.flatnonzero(frame["dim"].to_numpy() == dim)
            if len(rows):
                vectors, todo = _stacked(frame["v"].iloc[rows]), [(0, np.arange(len(rows)))]
                for place, some in todo:
                    if isinstance(splits[place], int):
                        cell[rows[some]] = splits[place]
                    elif len(some):
                        side, value, lower, upper = splits[place]
                        over = vectors[some, side] > value
                        todo += [(lower, some[~over]), (upper, some[over])]
            yield frame.assign(cell=cell)

    return points.mapInPandas(deal, "vec_id long, v array<long>, dim int, cell long")


_PARTS = ("ids", "vectors", "child", "spans", "lows", "highs")
_TREE = "dim int, shard long, low array<long>, high array<long>, " + ", ".join(f"{p} binary" for p in _PARTS)


def trees(points: DataFrame) -> DataFrame:
    """A row per shard: (dim, shard), its box (low, high), and the arrays of its tree, with ids and vectors in the tree's order."""
    count = int(np.clip(-(-points.count() // SHARD), *CELLS))
    cells = written(_dealt(points, *_cells(points, count)))
    sizes = cells.groupBy("dim", "cell").agg(F.ceil(F.count("*") / SHARD).alias("parts"))
    shard = F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("parts"))
    rows = cells.join(sizes, ["dim", "cell"]).select("vec_id", "v", "dim", shard.alias("shard"))

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        vectors, ids = _stacked(frame["v"]), frame["vec_id"].to_numpy()
        first = np.argsort(ids)
        vectors, ids = vectors[first], ids[first]
        tree = Tree(vectors)
        arrays = (ids[tree.order], vectors[tree.order], tree.child, tree.spans, tree.low, tree.high)
        row = {"dim": key[0], "shard": key[1], "low": tree.low[0], "high": tree.high[0]} | {p: a.astype("<i8").tobytes() for p, a in zip(_PARTS, arrays)}
        return pd.DataFrame([row])

    return written(rows.groupBy("dim", "shard").applyInPandas(build, _TREE))


def _routed(queries: DataFrame, boxes: DataFrame, home: bool) -> DataFrame:
    """``queries`` with the shards to go to: the one of the greatest bound, or the others whose bound reaches ``kth``."""
    shards, asked = boxes.count(), queries.count()
    chunks, blocks = max(1, -(-shards // BOXES)), max(1, -(-asked // ROUTED))
    over = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(blocks)).cast("int")).withColumn("chunk", over(chunks))
    right = boxes.withColumn("chunk", F.pmod(F.xxhash64("dim", "shard"), F.lit(chunks)).cast("int")).withColumn("block", over(blocks))

    def route(key: tuple, asks: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        out = asks[["query_id", "q", "dim", "kth", "home"]].copy()
        if not len(asks) or not len(cells):
            return out.iloc[:0].assign(shards=pd.Series([], dtype=object), bound=pd.Series([], dtype="float64"))
        q, low, high = _stacked(asks["q"]), _stacked(cells["low"]), _stacked(cells["high"])
        kind = _exact(q, np.vstack([low, high]))
        reach, names = bounds(q.astype(kind), low.astype(kind), high.astype(kind)), cells["shard"].to_numpy()
        if home:
            at = reach.argmax(1)
            return out.assign(shards=[names[i : i + 1] for i in at], bound=reach[np.arange(len(at)), at].astype(float))
        keep = (reach >= out["kth"].to_numpy()[:, None]) & (names[None, :] != out["home"].to_numpy()[:, None])
        return out.assign(shards=[names[k] for k in keep], bound=0.0)

    right = right.select("shard", "low", "high", *[F.col(c).alias(f"of_{c}") for c in ("dim", "chunk", "block")])
    keys = ["dim", "chunk", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*[f"of_{c}" for c in keys])).applyInPandas(route, "query_id long, q array<long>, dim int, kth long, home long, shards array<long>, bound double")
    if home and chunks > 1:
        found = found.groupBy("query_id").agg(F.max_by(F.struct("q", "dim", "kth", "home", "shards", "bound"), F.struct("bound", "shards")).alias("r")).select("query_id", "r.*")
    return written(found.where(F.size("shards") > 0).drop("bound"))


def _searched(routed: DataFrame, shards: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, home): the k best of each query in each shard it goes to."""
    pairs = routed.withColumn("shard", F.explode("shards")).drop("shards")
    parts = pairs.groupBy("dim", "shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    asked = pairs.join(parts, ["dim", "shard"]).withColumn("part", F.pmod(F.xxhash64("query_id", F.lit(7)), F.col("parts")).cast("int"))
    held = shards.drop("low", "high").join(parts, ["dim", "shard"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held = held.select(*_PARTS, *[F.col(c).alias(f"of_{c}") for c in ("dim", "shard", "part")])

    def best(key: tuple, asks: pd.DataFrame, trees_: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asks) and len(trees_):
            ids, raw, child, spans, low, high = (np.frombuffer(trees_[p].iloc[0], "<i8") for p in _PARTS)
            q, own, kth = _stacked(asks["q"]), asks["query_id"].to_numpy(), asks["kth"].to_numpy()
            raw, low, high = (x.reshape(-1, q.shape[1]) for x in (raw, low, high))
            kind = _exact(q, raw)
            vectors, tree = raw.astype(kind), Tree.of(child, spans.reshape(-1, 2), low.astype(kind), high.astype(kind))
            for at in range(0, len(q), TOGETHER):
                mine = slice(at, at + TOGETHER)
                near, scores, _ = search(tree, vectors, ids, q[mine].astype(kind), own[mine], kth[mine].astype(kind), k)
                real = scores > _NONE
                found.append(pd.DataFrame({"query_id": np.repeat(own[mine], real.sum(1)), "vec_id": near[real], "score": scores[real].astype(np.int64), "home": np.int64(key[1])}))
        return pd.concat(found) if found else pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("query_id", "vec_id", "score", "home")})

    keys = ["dim", "shard", "part"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*[f"of_{c}" for c in keys])).applyInPandas(best, "query_id long, vec_id long, score long, home long")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest scores of each query, ties to the lesser vec_id.

    ``vectors`` has vec_id and embedding; its rows with an id divisible by
    ``every`` are the queries, and all rows but the query's own are candidates.
    Rows with a null id, a null vector, an empty vector, or null or non-finite
    components take no part; vectors are compared with those of their own length
    only. Of rows that repeat an id, the least vector counts. With fewer than k
    candidates all are returned. Scores are exact as long as they fit 64 bits.
    Other columns are ignored.
    """
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(~bad)
    scaled = F.transform(x, lambda c: F.floor(c * SCALE).cast("long"))
    points = written(usable.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    shards = trees(points)
    boxes = shards.select("dim", "shard", "low", "high")

    none = F.lit(_NONE + 1).cast("long")
    asked = points.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "dim", none.alias("kth"), F.lit(None).cast("long").alias("home"))
    first = written(_ranked(_searched(_routed(asked, boxes, True), shards, k), k).drop("rank"))
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("low"), F.first("home").alias("at"))
    # a shard of the query alone gives no rows: it is searched again, in vain
    known = asked.drop("kth", "home").join(kth, "query_id", "left").select("query_id", "q", "dim", F.coalesce("low", none).alias("kth"), F.coalesce("at", F.lit(-1)).alias("home"))
    rest = _searched(_routed(written(known), boxes, False), shards, k)
    return _ranked(first.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with e as (select vec_id, list_transform(embedding, lambda x: cast(floor(x::double * 256) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from e q join e c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""

"""A Merkle manifest of a dataset: a tree per group of rows, a tree over the groups' roots, and proofs by coordinate.

The node store is a Parquet folder partitioned by level, so that no tree is ever
in memory:

1. Every row becomes a leaf digest where it is read; texts go no further. Leaves
   are sorted by (group, order) in ranges, which gives each its position in its
   tree, and written as level 0.
2. Runs of 2**STRIDE consecutive nodes of the last level that is stored meet in
   a task, in order. A run is an aligned subtree: the task makes each level from
   the one before in one pass, and writes STRIDE levels. Three such jobs hold
   trees of 6e10 leaves.
3. The roots of the groups' trees are the leaves of one more tree, stored alike.
4. Proofs are merge scans from the top down: a run of nodes meets the stored
   nodes of its own levels and the path above its root, and reads each sibling
   at its coordinate, position xor 1.

A digest is the lower-case hex SHA-256; a parent is the digest of its children's
concatenated hex texts, an only child's of that alone. What a node has no sibling
for is known from its position and the tree's size, so that a path is just the
siblings in a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import grouped, written
from tidegauge.operators.ranks import placed
from tidegauge.shared import shared_dir

#: Levels that a job adds; a run has two to this power nodes at most.
STRIDE = 12
#: Columns of a leaf, the column that parts the trees, the column that orders a tree's leaves.
COLUMNS, GROUP, ORDER = ("doc_id", "source", "lang", "n_chars", "text"), "lang", "doc_id"
#: The rows that a tampered copy changes: crc32 of the decimal doc_id is a multiple.
TAMPERED = 7

_NODES = "level int, tree long, pos long, hash binary"


def framed(value: Column) -> Column:
    """A value as text that can't run into the next one's: ``-`` for null, else its UTF-8 byte count, a colon, itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row's values."""
    return F.sha2(F.concat(*[framed(v) for v in values]).cast("binary"), 256)


def parent(children: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return max(0, n - 1).bit_length()


def _columns(values: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in values.values()], list(values))


def _levels(base: int, stride: int):
    """Batches of sorted runs of level ``base`` to the nodes of the ``stride`` levels above, or up to the tree's root."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in grouped(batches, ["tree", "run"]):
            trees, runs, sizes, hashes = (table[c].to_pylist() for c in ("tree", "run", "n", "hash"))
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                last, first, out = hashes[s:e], runs[s] << stride, []
                for level in range(base + 1, min(base + stride, height(sizes[s])) + 1):
                    last = [parent(last[k : k + 2]) for k in range(0, len(last), 2)]
                    first >>= 1
                    out += [(level, first + k, h) for k, h in enumerate(last)]
                level, pos, digest = zip(*out) if out else ((), (), ())
                yield _columns({"level": (level, pa.int32()), "tree": ([trees[s]] * len(out), pa.int64()), "pos": (pos, pa.int64()), "hash": (digest, pa.binary())})

    return made


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_NODES).parquet(folder)


def build(leaves: DataFrame, trees: DataFrame, folder: str, stride: int = STRIDE) -> int:
    """Write the node store of a forest and give its greatest height.

    ``leaves`` has tree long, pos long (0, 1, ... in a tree) and hash binary,
    ``trees`` tree and n, its leaves. Without leaves nothing is written but
    an empty level 0.
    """
    spark = leaves.sparkSession
    leaves.select(F.lit(0).alias("level"), "tree", "pos", "hash").write.partitionBy("level").parquet(folder)
    top = height(trees.agg(F.max("n")).first()[0] or 0)
    for base in range(0, top, stride):
        last = _stored(spark, folder).where(F.col("level") == base)
        runs = last.join(trees, "tree").withColumn("run", F.shiftright("pos", stride)).select("tree", "run", "pos", "n", "hash")
        made = runs.repartition("tree", "run").sortWithinPartitions("tree", "run", "pos").mapInArrow(_levels(base, stride), _NODES)
        made.write.mode("append").partitionBy("level").parquet(folder)
    return top


def _by_level(nodes: pa.Table, end: int) -> dict[int, tuple[int, list[bytes]]]:
    """The nodes of a run below level ``end``, by level: the first one's position, and the digests in order."""
    found: dict[int, list[tuple[int, bytes]]] = {}
    for level, pos, digest in zip(*(nodes[c].to_pylist() for c in ("level", "pos", "hash"))):
        if level < end:
            found.setdefault(level, []).append((pos, digest))
    return {level: (min(x)[0], [d for _, d in sorted(x)]) for level, x in found.items()}


def _path(by_level: dict[int, tuple[int, list[bytes]]], base: int, end: int, pos: int, n: int) -> bytes:
    """Siblings of the node ``pos`` of level ``base`` below level ``end``, from below, in a row."""
    out = []
    for level in range(base, min(end, height(n))):
        beside = pos ^ 1
        if beside < -(-n >> level):  # ceil of n / 2**level
            first, digests = by_level[level]
            out.append(digests[beside - first])
        pos >>= 1
    return b"".join(out)


def folded(digest: bytes, pos: int, n: int, path: bytes) -> tuple[bytes, bytes]:
    """The root that a leaf's digest and its siblings give, and what is left of the path."""
    for level in range(height(n)):
        if pos ^ 1 < -(-n >> level):
            beside, path = path[:32], path[32:]
            digest = parent((beside, digest) if pos & 1 else (digest, beside))
        else:
            digest = parent((digest,))
        pos >>= 1
    return digest, path


def _paths(base: int, end: int):
    """Of a run's nodes at level ``base`` (left), and the stored nodes and the path above (right), the whole paths."""

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        by_level = _by_level(right, end)
        above = right.filter(pa.compute.equal(right["level"], end)).to_pylist()[:1] or [{"path": b"", "subroot": None}]
        path = [_path(by_level, base, end, pos, n) + above[0]["path"] for pos, n in zip(left["pos"].to_pylist(), left["n"].to_pylist())]
        return left.select(_ITEM).append_column("path", pa.array(path, pa.binary())).append_column("subroot", pa.array([above[0]["subroot"]] * len(path), pa.binary()))

    return scan


_ITEM = ["row", "tree", "pos", "n", "k"]


def paths(items: DataFrame, trees: DataFrame, folder: str, top: int, stride: int = STRIDE) -> DataFrame:
    """(row, tree, pos, n, k, path, subroot): the siblings of leaves, from each up to its tree's root and on.

    ``items`` has row (whatever goes with a leaf), tree and pos; ``trees`` has
    tree, n and k, and what stands above a tree's root: path and subroot, the root itself.
    """
    nodes, crown = _stored(items.sparkSession, folder), None
    again = _stored(items.sparkSession, folder)  # read for the other side: two sides of one table have ambiguous columns
    kind = items.schema["row"].dataType.simpleString()
    nothing, zero = F.lit(None).cast("binary"), F.lit(0).cast("long")
    for base in reversed(range(0, max(top, 1), stride)):
        lowest = F.col("n") > (1 << base) if base else F.lit(True)
        here = trees.where(lowest & (F.col("n") <= (1 << (base + stride)))).select("tree", zero.alias("run"), "path", "subroot")
        if crown is not None:
            here = here.unionByName(crown.select("tree", F.col("pos").alias("run"), "path", "subroot"))
        wanted = again.where(F.col("level") == base).select(F.lit(None).cast(kind).alias("row"), "tree", "pos") if base else items
        left = wanted.join(trees.where(lowest).select("tree", "n", "k"), "tree").withColumn("run", F.shiftright("pos", stride)).select("run", *_ITEM)
        own = nodes.where(F.col("level").between(base, base + stride - 1)).withColumn("run", F.expr(f"shiftright(pos, {stride + base} - level)"))
        right = own.select("tree", "run", "level", "pos", "hash", nothing.alias("path"), nothing.alias("subroot"))
        right = right.unionByName(here.select("tree", "run", F.lit(base + stride).alias("level"), zero.alias("pos"), nothing.alias("hash"), "path", "subroot"))
        found = left.groupBy("tree", "run").cogroup(right.groupBy("tree", "run")).applyInArrow(_paths(base, base + stride), f"row {kind}, tree long, pos long, n long, k long, path binary, subroot binary")
        crown = written(found) if base else found
    return crown


def _verdicts(trees: int):
    """The proofs' digests, and the roots that the claimed leaves fold to."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pos, n, k, path, claimed in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("pos", "n", "k", "path", "claimed"))):
                root, rest = folded(claimed, pos, n, path)
                out.append((hashlib.sha256(path.hex().encode()).hexdigest(), folded(root, k, trees, rest)[0].hex()))
            proof, root = zip(*out) if out else ((), ())
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "leaf", "subroot")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(proof, pa.string()), pa.array(root, pa.string())], ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])

    return judged


def manifest(docs: DataFrame, claimed: Column | None = None, folder: str | None = None, stride: int = STRIDE) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of ``docs``.

    ``docs`` has the columns COLUMNS; others are ignored, whatever their names.
    ``claimed`` is a leaf digest to be held against the manifest, made of the
    columns of ``docs``; the rows' own where it is not given. ``folder`` gets the
    node stores (``nodes`` of the groups' trees, ``roots`` of the tree over
    them); a new one of the shared folder if not given.

    Nulls of any column are framed as ``-`` and null groups are a group, the
    first. Rows that repeat a doc_id are leaves of their own, in the order of
    their digests. An empty table gives no rows, and a lone row's leaf is root
    and subroot, with an empty proof.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    own = leaf(*[F.col(c) for c in COLUMNS])
    group = F.coalesce(F.concat(F.lit("="), F.col(GROUP).cast("string")), F.lit(""))  # null first, else in the order of the bytes
    rows = written(docs.select(group.alias("group"), F.col(ORDER).cast("long").alias("doc_id"), own.alias("leaf"), (own if claimed is None else claimed).alias("claimed")))
    rows = written(placed(rows, "group", "doc_id", "leaf", "claimed").drop("part"))
    trees = written(rows.groupBy("group").agg(F.min("place").alias("tree"), F.count("*").alias("n")))
    rows = rows.join(trees, "group").withColumn("pos", F.col("place") - F.col("tree"))

    top = build(rows.select("tree", "pos", F.unhex("leaf").alias("hash")), trees.select("tree", "n"), f"{folder}/nodes", stride)
    level = F.when(F.col("n") == 1, 0).otherwise(F.length(F.bin(F.col("n") - 1)))
    subroots = _stored(spark, f"{folder}/nodes").join(trees, "tree").where((F.col("pos") == 0) & (F.col("level") == level))
    subroots = written(placed(subroots.select("tree", "n", F.col("hash").alias("subroot")), "tree").select("tree", "n", "subroot", F.col("place").alias("k")))
    groups, zero = subroots.count(), F.lit(0).cast("long")
    one = spark.createDataFrame([(0, groups, 0, b"", b"")], "tree long, n long, k long, path binary, subroot binary")
    above = build(subroots.select(zero.alias("tree"), F.col("k").alias("pos"), F.col("subroot").alias("hash")), one.select("tree", "n"), f"{folder}/roots", stride)
    found = _stored(spark, f"{folder}/roots").where(F.col("level") == above).first()
    root = found.hash.hex() if found else None

    crowns = paths(subroots.select(F.col("tree").alias("row"), zero.alias("tree"), F.col("k").alias("pos")), one, f"{folder}/roots", above, stride)
    trees = written(subroots.join(crowns.select(F.col("row").alias("tree"), "path"), "tree"))
    proofs = paths(rows.select(F.struct("doc_id", "leaf", F.unhex("claimed").alias("claimed")).alias("row"), "tree", "pos"), trees, f"{folder}/nodes", top, stride)
    full = proofs.select("row.doc_id", "row.leaf", "row.claimed", "pos", "n", "k", "path", F.lower(F.hex("subroot")).alias("subroot"))
    checked = full.mapInArrow(_verdicts(groups), "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    expected = F.lit(root).cast("string")
    return checked.select("doc_id", "leaf", "subroot", expected.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == expected).alias("verified"))


def tampered_leaf() -> Column:
    """The leaf of a row whose n_chars is one more in each row of TAMPERED, by doc_id."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    changed = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return leaf(*[changed if c == "n_chars" else F.col(c) for c in COLUMNS])


_FRAME = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FRAME.format(c) for c in COLUMNS) + ")"
_CHANGED = "sha256(" + " || ".join(_FRAME.format("m_chars" if c == "n_chars" else c) for c in COLUMNS) + ")"
_CRC = "xor(list_reduce([4294967295::bigint] || [ord(x)::bigint for x in string_split(doc_id::varchar, '')], lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295)"

ORACLE = f"""
with recursive d as (select *, case when coalesce({_CRC} % {TAMPERED} = 0, false) then n_chars + 1 else n_chars end as m_chars from documents),
l as (select doc_id, lang, {_LEAF} as leaf, {_CHANGED} as claimed from d),
p as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf, claimed) - 1 as pos, dense_rank() over (order by lang nulls first) - 1 as k, count(*) over (partition by lang) as n from l),
nodes as (
  select k, 0 as level, pos, leaf as h, n from p
  union all
  select k, level + 1, pos // 2, h, (n + 1) // 2 from (select k, level, pos, n, sha256(h || coalesce(lead(h) over (partition by k order by pos), '')) as h from nodes where n > 1) where pos % 2 = 0),
subroots as (select k, h from nodes where n = 1),
tops as (
  select k as pos, 0 as level, h, (select count(*) from subroots) as n from subroots
  union all
  select pos // 2, level + 1, h, (n + 1) // 2 from (select pos, level, n, sha256(h || coalesce(lead(h) over (order by pos), '')) as h from tops where n > 1) where pos % 2 = 0),
siblings as (
  select p.k, p.pos, s.level, s.h from p join nodes s on s.k = p.k and s.n > 1 and s.pos = xor(p.pos >> s.level, 1)
  union all
  select p.k, p.pos, 1000 + s.level, s.h from p join tops s on s.n > 1 and s.pos = xor(p.k >> s.level, 1)),
proofs as (select k, pos, string_agg(h, '' order by level) as path from siblings group by k, pos),
steps as (
  select k, pos, row_number() over (partition by k, pos order by level) as i, side, s from (
    select p.k, p.pos, m.level, (p.pos >> m.level) & 1 as side, s.h as s from p join (select distinct k, level from nodes where n > 1) m on m.k = p.k left join siblings s on s.k = p.k and s.pos = p.pos and s.level = m.level
    union all
    select p.k, p.pos, 1000 + m.level, (p.k >> m.level) & 1, s.h from p cross join (select distinct level from tops where n > 1) m left join siblings s on s.k = p.k and s.pos = p.pos and s.level = 1000 + m.level)),
fold as (
  select k, pos, 0 as i, claimed as h from p
  union all
  select f.k, f.pos, f.i + 1, sha256(case when side = 1 then coalesce(s, '') || h else h || coalesce(s, '') end) from fold f join steps t on t.k = f.k and t.pos = f.pos and t.i = f.i + 1),
ends as (select k, pos, arg_max(h, i) as folded_root from fold group by k, pos)
select doc_id, leaf, s.h as subroot, r.h as root, sha256(coalesce(path, '')) as proof_sha256, folded_root, folded_root = r.h as verified
from p join ends using (k, pos) left join proofs using (k, pos) join subroots s using (k) cross join (select h from tops where n = 1) r
"""

"""Mixing sources to target weights by capped water-filling and seeded repetitions.

A budget of words is shared among sources by weight.  No source gives more than
``max_epochs`` times its own words: sources whose share would exceed that are
clamped there and the excess goes to the others by weight.  In ascending order
of cap/weight the clamped sources are a prefix, so that one pass of running sums
over the (few) sources gives the level instead of repeated rounds.

A source with target ``t`` and size ``s`` takes every document ``floor(t / s)``
times, and once more the documents whose seeded digests come first, until the
rest ``t - s * floor(t / s)`` is met as closely as whole documents allow.  The
digest at which a source is cut is found by sums over 256 buckets, then over the
256 parts of the bucket where the cut falls, then over that part's documents: no
task orders a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import unit_hash, word_count, written

SEED = "mix-1"
MAX_EPOCHS = 3


def cyclic_weights(sources: DataFrame) -> DataFrame:
    """``sources`` with weights 1, 2, 3, 1, 2, 3, ... in code point order of ``source``, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", ((place - 1) % 3 + 1).cast("double"))


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS, budget: F.Column | None = None) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``: shares of ``budget`` (default: all sizes).

    The windows run over one row per source. Sources of size 0 get 0; with all
    sizes 0 every target is 0; an infeasible budget clamps every source.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = budget if budget is not None else F.sum("source_size").over(everything).cast("double")
    cap = F.col("source_size") * F.lit(float(max_epochs))
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    run = sources.withColumn("_total", total).withColumn("_weights", F.sum("weight").over(everything)).withColumn("_cap", cap).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    run = run.withColumn("_c", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_w", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    run = run.withColumn("_clamped", F.col("_cap") * (F.col("_weights") - F.col("_w")) <= F.col("weight") * (F.col("_total") - F.col("_c")))
    gone = F.sum(F.when(F.col("_clamped"), F.col("_cap")).otherwise(0.0)).over(everything)
    held = F.sum(F.when(F.col("_clamped"), F.col("weight")).otherwise(0.0)).over(everything)
    level = F.try_divide(F.col("_total") - gone, F.col("_weights") - held)
    run = run.withColumn("target", F.when(F.col("_clamped"), F.col("_cap")).otherwise(F.col("weight") * level))
    return run.drop("_total", "_weights", "_cap", "_ratio", "_c", "_w", "_clamped")


def _cut(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source the greatest digest that is taken once more (null: none)."""
    digest = sizes.withColumn("_h", unit_hash(F.col("doc_id"), seed=SEED))
    parts = written(digest.groupBy("source", F.substring("_h", 1, 2).alias("b1"), F.substring("_h", 3, 2).alias("b2")).agg(F.sum("size").alias("words")))
    need = sources.select("source", (F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")).alias("need")).where("need > 0")

    def crossing(rows: DataFrame, key: str, fixed: list[str]) -> DataFrame:
        """The bucket of each source in which the running words reach what it needs, and what it then still needs."""
        order = Window.partitionBy("source").orderBy(key)
        rows = rows.withColumn("_upto", F.sum("words").over(order)).where("_upto >= need")
        first = rows.groupBy("source", "need").agg(F.min(F.struct(key, "_upto", "words")).alias("_first"))
        return first.select("source", *fixed, F.col(f"_first.{key}").alias(key), (F.col("need") - F.col("_first._upto") + F.col("_first.words")).alias("need"))

    def of(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
        wanted = wanted.select(F.col("source").alias("_s"), *[F.col(k).alias(f"_{k}") for k in keys], "need")
        same = F.col("source").eqNullSafe(F.col("_s"))
        for k in keys:
            same = same & (F.col(k) == F.col(f"_{k}"))
        return rows.join(wanted, same).drop("_s", *[f"_{k}" for k in keys])

    one = crossing(of(parts.groupBy("source", "b1").agg(F.sum("words").alias("words")), need, []), "b1", [])
    two = written(crossing(of(parts, one, ["b1"]), "b2", []).withColumnRenamed("need", "_need").join(one.select(F.col("source").alias("_s"), F.col("b1").alias("_b1")), F.col("source").eqNullSafe(F.col("_s"))).select("source", F.col("_b1").alias("b1"), "b2", F.col("_need").alias("need")))
    last = digest.withColumns({"b1": F.substring("_h", 1, 2), "b2": F.substring("_h", 3, 2)})
    last = of(last, two, ["b1", "b2"]).groupBy("source", "need", "b1", "b2", "_h").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("_h")
    upto = F.sum("words").over(order)
    inside = last.withColumn("_in", upto - F.col("words") / 2 <= F.col("need")).groupBy("source").agg(F.max(F.when(F.col("_in"), F.col("_h"))).alias("_last"))
    # nothing of the part itself fits: everything before the part is still taken
    joined = two.select(F.col("source").alias("_s"), F.concat("b1", "b2").alias("_start")).join(inside, F.col("source").eqNullSafe(F.col("_s")), "left")
    return joined.select(F.col("_s").alias("source"), F.coalesce("_last", "_start").alias("cut"))


def plan(sizes: DataFrame, max_epochs: float = MAX_EPOCHS, weights=cyclic_weights, budget=None) -> DataFrame:
    """Per source: source_size, target, whole (copies of every document) and cut, as a written table."""
    sources = written(water_fill(weights(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))), max_epochs, budget))
    cuts = _cut(sizes, sources).withColumnRenamed("source", "_s")
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("int")
    rows = sources.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left")
    return written(rows.select("source", "source_size", "target", whole.alias("whole"), "cut"))


def _with_copies(rows: DataFrame, plan_rows: DataFrame) -> DataFrame:
    chosen = plan_rows.withColumnRenamed("source", "_s")
    extra = F.coalesce(unit_hash(F.col("doc_id"), seed=SEED) <= F.col("cut"), F.lit(False))
    # the plan has one row per source: Spark broadcasts it where its written size allows
    return rows.join(chosen, F.col("source").eqNullSafe(F.col("_s"))).withColumn("copies", F.col("whole") + extra.cast("int")).drop("_s", "whole", "cut")


def sizes_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def mixture(docs: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of each row of ``docs`` (doc_id, source, text).

    Null texts have size 0; rows with a null source form a source of their own,
    the last; rows that repeat a doc_id are taken or left together. An empty
    table gives an empty one; further columns are ignored.
    """
    sizes = written(sizes_of(docs))
    rows = _with_copies(sizes, plan(sizes, max_epochs))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it."""
    columns = docs.columns
    kept = docs.select(F.struct(*[F.col(c) for c in columns]).alias("_row"), "doc_id", "source")
    rows = _with_copies(kept, plan(written(sizes_of(docs)), max_epochs)).where("copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


ORACLE = r"""
with s as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5('mix-1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
src as (select source, cast(sum(size) as bigint) as source_size, cast((row_number() over (order by source asc nulls last) - 1) % 3 + 1 as double) as weight from s group by source),
a as (select *, cast(sum(source_size) over () as double) as total, sum(weight) over () as weights, source_size * 3.0::double as cap from src),
b as (select *, coalesce(sum(cap) over w, 0) as c, coalesce(sum(weight) over w, 0) as w0 from a window w as (order by cap / weight, source asc nulls last rows between unbounded preceding and 1 preceding)),
k as (select *, cap * (weights - w0) <= weight * (total - c) as clamped from b),
t as (select source, source_size, case when clamped then cap else weight * ((total - sum(case when clamped then cap else 0 end) over ()) / nullif(weights - sum(case when clamped then weight else 0 end) over (), 0)) end as target from k),
r as (select s.doc_id, s.size, s.h, t.source_size, t.target, s.source,
  case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as whole,
  sum(s.size) over (partition by s.source order by s.h) as upto
  from s join t on s.source is not distinct from t.source)
select doc_id, source, cast(size as bigint) as size, source_size, target,
  cast(whole + case when upto - size / 2.0 <= target - whole * source_size and target - whole * source_size > 0 then 1 else 0 end as integer) as copies,
  cast(size * (whole + case when upto - size / 2.0 <= target - whole * source_size and target - whole * source_size > 0 then 1 else 0 end) as bigint) as taken
from r
"""

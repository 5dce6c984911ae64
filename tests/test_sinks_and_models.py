"""Replaced tables, logs of streams, batched inference, loose JSON, and readers that stop."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import inference, merge
from tidegauge.session import prepare
from tidegauge.sources import files
from tidegauge.streaming import incremental, runlog


def test_a_replaced_table_is_whole_at_all_times(spark, tmp_path):
    spark, path = prepare(spark), f"file://{tmp_path}/t"
    assert files.current_version(spark, path) is None
    with pytest.raises(FileNotFoundError):
        files.read_replaced(spark, path)
    files.replace_table(spark.range(3), path)
    begun = files.read_replaced(spark, path)
    first = files.current_version(spark, path)
    with pytest.raises(Exception):  # noqa: B017
        files.replace_table(spark.range(5).select(F.raise_error(F.lit("a write that fails")).alias("id")), path)
    assert files.current_version(spark, path) == first and files.read_replaced(spark, path).count() == 3
    assert files.replace_table(spark.range(7), path).count() == 7
    assert begun.count() == 3  # a reader that has begun goes on
    files.replace_table(spark.range(1).toDF("other"), path)
    assert files.read_replaced(spark, path).columns == ["other"]
    assert len(list((tmp_path / "t").glob("version-*"))) == 2 and not list((tmp_path / "t").glob("_pointer.*"))


def test_runs_of_streams_are_logged(spark, tmp_path):
    spark = prepare(spark)
    when = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(k, when, 1, "a", 1.0, "") for k in range(30)], incremental.EVENTS).repartition(3).write.parquet(f"{tmp_path}/events.parquet")

    def fail(rows, batch):
        raise RuntimeError("no room")

    run = lambda each: incremental.drained(incremental.source(spark, str(tmp_path)), each=each)
    with pytest.raises(Exception, match="no room"):
        runlog.logged(spark, lambda: run(fail), f"file://{tmp_path}/log")
    log = runlog.logged(spark, lambda: run(lambda rows, batch: rows.count()), f"file://{tmp_path}/log").collect()
    by = {r.state: r for r in log}
    assert set(by) == {"failed", "finished"} and "no room" in by["failed"].error and by["finished"].error is None
    assert by["finished"].input_rows == 30 and by["finished"].batches >= 1 and by["failed"].run_id != by["finished"].run_id


def test_a_model_is_loaded_once_and_batches_dont_matter(spark, tmp_path):
    spark, path = prepare(spark), f"file://{tmp_path}/model"
    docs = spark.createDataFrame([("fine text", True), ("fine words", True), ("bad text", False), ("bad words", False), (None, True), ("x", None)], "text string, good boolean")
    inference.fitted(docs, path)
    weights = {r.word: r.weight for r in spark.read.parquet(path).collect()}
    assert set(weights) == {"fine", "bad", "text", "words"} and weights["text"] == 0 and weights["fine"] == pytest.approx(-weights["bad"]) and weights["fine"] > 1
    texts = ["Fine", "bad BAD", "", "  ", None, "unknown", "fine " * 256 + "bad " * 5000] * 40
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").repartition(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    one, other = ({r.k: r for r in rows.select("k", inference.scores(path, n)("t").alias("s")).select("k", "s.*").collect()} for n in (16, 5))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert {k: r.probability for k, r in one.items()} == {k: r.probability for k, r in other.items()}
    assert {r.loads for r in one.values()} == {1}  # 22 batches, one load
    assert one[0].probability == one[6].probability > 0.7 > 0.5 == one[2].probability == one[3].probability == one[4].probability == one[5].probability > one[1].probability


def test_loads_are_counted_for_each_model(spark, tmp_path):
    """A worker that has loaded another model before has still loaded this one once."""
    spark = prepare(spark)
    rows = spark.createDataFrame([(k, "fine") for k in range(40)], "k long, t string").repartition(1)
    for name in ("first", "second", "third"):
        path = f"file://{tmp_path}/{name}"
        spark.createDataFrame([("fine", 1.0)], "word string, weight double").coalesce(1).write.parquet(path)
        assert {r.loads for r in rows.select(inference.scores(path)("t").alias("s")).select("s.loads").collect()} == {1}


def test_variants_of_loose_answers(spark):
    bodies = ['[{"a": 1}, 2, null]', '{"data": [{"a": "x"}]}', '{"items": []}', '{"data": 3, "items": [{"a": 1.5}]}', "{", "", None, "7"]
    rows = prepare(spark).createDataFrame([(k, b) for k, b in enumerate(bodies)], "k long, b string").select("k", F.explode(files.variants(F.col("b"))).alias("v"))
    got = [(r.k, r.a) for r in rows.select("k", F.try_variant_get("v", "$.a", "string").alias("a")).collect()]
    assert sorted(got, key=str) == sorted([(0, "1"), (0, None), (0, None), (1, "x"), (3, "1.5")], key=str)


def test_readers_stop(spark):
    """Two empty pages in a row, one alone, a page that is too old, an empty first page, and a reader without items."""
    day = lambda n: dt.datetime(2024, 1, n)
    pages = {"two": [[9], [], [8], [], [], [7]], "old": [[9, 8], [3, 2], [1]], "edge": [[9], [5], [4], [3]], "late": [[], [6], []], "none": [[], []]}
    items = [(k, p, day(d), d) for k, x in pages.items() for p, ds in enumerate(x) for d in ds]
    spark = prepare(spark)
    listed = spark.createDataFrame([(k, p) for k, x in pages.items() for p in range(len(x))], "key string, page int")
    got = merge.taken_pages(spark.createDataFrame(items, "key string, page int, ts timestamp_ntz, event_id long"), listed, ["key"], F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"))
    found: dict = {}
    for r in got.collect():
        found.setdefault(r.key, set()).add(r.event_id)
    assert found == {"two": {9, 8}, "old": {9, 8, 3, 2}, "edge": {9, 5, 4}, "late": {6}}


def test_tables_are_reloaded_in_order_or_not_at_all(spark, tmp_path):
    spark, path = prepare(spark), f"file://{tmp_path}/all"
    parent, child = spark.range(3).toDF("id"), spark.createDataFrame([(1, 2), (2, None), (3, 0)], "k long, parent long")
    both = lambda c, p: {"child": (c, {"parent": ("parent", "id")}), "parent": (p, {})}
    assert list(files.reload_tables(both(child, parent), path)) == ["parent", "child"]
    with pytest.raises(ValueError, match="child.parent"):
        files.reload_tables(both(child, parent.where("id < 2")), path)
    assert files.read_replaced(spark, f"{path}/parent").count() == 3
    with pytest.raises(ValueError, match="circle"):
        files.reload_tables({"a": (parent, {"id": ("b", "id")}), "b": (parent, {"id": ("a", "id")})}, path)

"""The source of answers paged by a cursor: where chains end, what filters spare, and streams that go on."""

import json

import pytest

from tidegauge.session import prepare
from tidegauge.sources import cursor
from tidegauge.streaming import incremental


def save(folder, channel, answers):
    (folder / channel).mkdir(exist_ok=True)
    for at, items in answers.items():
        (folder / channel / f"{at}.json").write_text(items if isinstance(items, str) else json.dumps(items))


def item(i, moment=None, **more):
    return {"Id": i, "FriendlyTitle": f"t{i}", "Date": moment} | more


@pytest.fixture
def folder(tmp_path):
    save(tmp_path, "plain", {"first": [item(9, "2024-03-09"), item(8, "2024-03-08")], "8": [{"id": "7", "friendly_title": "t7", "body": 5}, {"title": "no id"}, "odd", None], "7": []})
    save(tmp_path, "broken", {"first": [item(5)], "5": "{not json"})
    save(tmp_path, "object", {"first": {"Id": 1}})
    save(tmp_path, "loop", {"first": [item(3)], "3": [item(3)]})
    save(tmp_path, "old", {"first": [item(20, "2024-05-02"), item(19, "2024-05-01")], "19": [item(18, "2024-02-01")], "18": [item(17, "2024-01-01")]})
    return tmp_path


def ids(df):
    found = {}
    for r in df.select("channel", "id").collect():
        found.setdefault(r.channel, []).append(r.id)
    return {c: sorted(x, reverse=True) for c, x in found.items()}


def read(spark, folder, **options):
    return cursor.registered(prepare(spark)).read.format("cursor_pages").options(path=f"file://{folder}", **options).load()


def test_where_chains_end(spark, folder):
    rows = read(spark, folder)
    assert ids(rows) == {"plain": [9, 8, 7], "broken": [5], "loop": [3], "old": [20, 19, 18, 17]}
    assert [(r.title, r.moment, r.body) for r in rows.where("id = 7").collect()] == [("t7", None, "5")]
    assert ids(read(spark, folder, pages=1)) == {"plain": [9, 8], "broken": [5], "loop": [3], "old": [20, 19]}
    assert ids(read(spark, folder, channels="old, none", since="2024-04-01")) == {"old": [20, 19, 18]}
    assert read(spark, folder / "nothing").count() == 0


def test_filters_spare_chains_and_answers(folder):
    reader = cursor.Reader({"path": f"file://{folder}"}, cursor.StructType.fromDDL("id long, channel string"))
    wanted, since, other = cursor.In(("channel",), ("old", "plain")), cursor.GreaterThanOrEqual(("moment",), "2024-04-01"), cursor.EqualTo(("id",), 7)
    assert list(reader.pushFilters([wanted, since, other])) == [since, other]
    parts = reader.partitions()
    assert [p.channel for p in parts] == ["old", "plain"] and list(reader.read(parts[0])) == [(20, "old"), (19, "old"), (18, "old")]


def test_filtered_rows_are_right(spark, folder):
    rows = read(spark, folder)
    assert ids(rows.where("channel = 'old' and moment >= '2024-02-01'")) == {"old": [20, 19, 18]}
    assert ids(rows.where("channel in ('old', 'loop') and id < 19")) == {"loop": [3], "old": [18, 17]}


def test_a_stream_goes_on_at_its_cursors(spark, folder):
    got = []

    def run():
        stream = cursor.registered(prepare(spark)).readStream.format("cursor_pages").option("path", f"file://{folder}").load()
        incremental.drained(stream, each=lambda rows, _: got.extend((r.channel, r.id) for r in rows.collect()), checkpoint=f"file://{folder}.checkpoint")

    run()
    before = sorted(got)
    assert before == sorted([("plain", 9), ("plain", 8), ("plain", 7), ("broken", 5), ("loop", 3), *(("old", i) for i in (20, 19, 18, 17))])
    run()
    assert sorted(got) == before
    save(folder, "plain", {"7": [item(6), item(4)]})
    save(folder, "fresh", {"first": [item(1)]})
    run()
    assert sorted(got) == sorted([*before, ("plain", 6), ("plain", 4), ("fresh", 1)])

"""Operators and functions against brute force and hand-computed cases."""

import datetime as dt
import math
import random
import time
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from compare import DATA

from tidegauge import shared
from tidegauge.functions import fixed_values, text
from tidegauge.functions.windows import change, full, frame, obv
from tidegauge.operators import association, changepoint, merge, metrics, ranks
from tidegauge.operators import scan as scan_
from tidegauge.operators.ewm import with_ewm
from tidegauge.plans.dashboard import scan
from tidegauge.plans.models import pooled_quantiles
from tidegauge.plans.texts import valid_entities
from tidegauge.session import prepare
from tidegauge.sources import files
from tidegauge.streaming import incremental


def _cost(z, a, b):
    return ((z[a:b] - z[a:b].mean()) ** 2).sum()


def _all_breaks(values, penalty, jump, segment):
    """Unpruned dynamic programming over the same grid."""
    z, n = (values - values.mean()) / values.std(), len(values)
    grid = [0] + [t for t in range(jump, n, jump) if t >= segment] + [n]
    best, back = {0: 0.0}, {}
    for t in grid[1:]:
        options = [(best[a] + _cost(z, a, t) + penalty * math.log(n) * (a > 0), a) for a in grid if a < t and t - a >= segment and a in best]
        if options:
            best[t], back[t] = min(options)
    out, t = [], n
    while back.get(t, 0) > 0:
        t = back[t]
        out.append(t)
    return out[::-1], best[n]


@pytest.mark.parametrize("seed", range(6))
def test_change_points_match_unpruned_search(seed):
    rng = np.random.default_rng(seed)
    values = np.concatenate([rng.normal(m, 1, rng.integers(20, 60)) for m in rng.normal(0, 2, 4)])
    found = changepoint.breakpoints(values)
    expected, total = _all_breaks(values, changepoint.PENALTY, changepoint.JUMP, changepoint.SEGMENT)
    z = (values - values.mean()) / values.std()
    edges = [0, *found, len(values)]
    own = sum(_cost(z, a, b) for a, b in zip(edges, edges[1:])) + len(found) * changepoint.PENALTY * math.log(len(values))
    assert own == pytest.approx(total) and len(found) == len(expected)


def test_step_flat_and_short_series(spark):
    noise = np.random.default_rng(1).normal(0, 0.01, 200)
    step = np.concatenate([np.zeros(100), np.ones(100)]) + noise
    assert changepoint.breakpoints(step) == [100]
    assert changepoint.breakpoints(np.ones(150)) == []
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(200)]
    rows = [("a", d, float(x)) for d, x in zip(days, step)] + [("b", d, float(x)) for d, x in zip(days[:99], step)]
    found = changepoint.change_points(prepare(spark).createDataFrame(rows, "symbol string, date date, value double")).collect()
    assert [(r.symbol, r.place) for r in found] == [("a", 100)]


def test_ewm_and_rolling_edges(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(25)]
    closes = [1.0, 2.0, 3.0, 4.0] + [5.0] * 21
    b = prepare(spark).createDataFrame([("a", d, c, 0 if i == 3 else 2) for i, (d, c) in enumerate(zip(days, closes))], "symbol string, date date, close double, volume long")
    e = with_ewm(b, {"plain": ("close", dict(alpha=0.5, adjust=False)), "adjusted": ("close", dict(alpha=0.5))}).orderBy("date").toPandas()
    assert list(e["plain"][:4]) == [1, 1.5, 2.25, 3.125]
    assert [round(x, 4) for x in e["adjusted"][:4]] == [1, 1.6667, 2.4286, 3.2667]
    chained = with_ewm(b, {"fast": ("close", dict(span=3, adjust=False)), "slow": ("close", dict(span=7, adjust=False)), "line": ("fast - slow", dict(span=5, adjust=False, min_periods=4))}).orderBy("date").toPandas()
    want = pd.Series(closes)
    line = (want.ewm(span=3, adjust=False).mean() - want.ewm(span=7, adjust=False).mean()).ewm(span=5, adjust=False, min_periods=4).mean()
    assert np.allclose(chained["line"].to_numpy(float), line.to_numpy(), equal_nan=True)
    r = b.select("date", full(F.avg, F.col("close"), frame(20), 20).alias("m"), change(F.col("volume")).alias("v"), obv(F.col("close"), F.col("volume")).alias("o")).orderBy("date").toPandas()
    assert r["m"].isna().sum() == 19
    assert pd.isna(r["v"][4]) and r["v"][3] == -1  # a change from zero is unknown
    assert r["o"][0] == 0 and set(r["o"][4:6]) <= {0.0, 2.0}


def test_lexicon_negation_and_overlap(spark):
    spark = prepare(spark)
    score = text.lexicon()
    cases = [("Công ty chia cổ tức", 1, 0), ("không chia cổ tức", 0, 1), ("không" + " " * 20 + "chia cổ tức", 1, 0), ("LỢI NHUẬN TĂNG TRƯỞNG", 1, 0), ("không thua lỗ", 1, 0), ("lãi giảmx", 0, 0), ("", 0, 0), (None, 0, 0)]
    found = spark.createDataFrame([(t,) for t, _, _ in cases], "t string").select(score("t").alias("x")).collect()
    assert [(r.x.pos, r.x.neg) for r in found] == [(p, n) for _, p, n in cases]
    assert len(fixed_values.POSITIVE) == 56 and len(fixed_values.NEGATIVE) == 66 and len(fixed_values.MEMBERSHIP) == 50


def test_tagger(spark):
    tag = text.tagger()
    cases = [("gas giá", []), ("GAS tăng", ["GAS"]), ("(VCB)", ["VCB"]), ("XHPG", []), ("NATURAL GAS lên", []), ("Vietcombank và hòa phát", ["HPG", "VCB"]), (None, [])]
    found = prepare(spark).createDataFrame([(t,) for t, _ in cases], "t string").select(tag("t").alias("x")).collect()
    assert [r.x for r in found] == [x for _, x in cases]


def test_article(spark):
    long = "Đoạn văn đủ dài để được giữ lại trong bài."
    html = f'<html><head><meta property="og:title" content="T"></head><body><nav><p>{long}</p></nav><div class="sidebar"><p>{long}</p></div><p>{long}<p>{"x" * 29}</p><p>[{"y" * 40}]</p><p>https://{"z" * 40}</p><p>{long} Email: a</p></body></html>'
    rows = prepare(spark).createDataFrame([(html,), ("<h1>H</h1>",), (None,)], "h string").select(text.article(F.col("h")).alias("a")).select("a.*").collect()
    assert rows[0].title == "T" and rows[0].content == long and rows[0].paragraphs == 1
    assert rows[1].title == "H" and rows[2].title is None


def test_merges(spark):
    spark = prepare(spark)
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    batch = spark.createDataFrame([(2, "c", 5), (2, "d", 6), (3, "e", 1)], "k int, v string, t int")
    once = merge.upsert(stored, batch, ["k"], ["t"])
    assert {(r.k, r.v) for r in once.collect()} == {(1, "a"), (2, "d"), (3, "e")}
    assert {(r.k, r.v) for r in merge.upsert(once, batch, ["k"], ["t"]).collect()} == {(1, "a"), (2, "d"), (3, "e")}
    assert {(r.k, r.v) for r in merge.insert_new(stored, batch, ["k"], ["t"]).collect()} == {(1, "a"), (2, "b"), (3, "e")}


def test_event_window_edges_and_no_signal(spark):
    spark = prepare(spark)
    d = dt.date(2020, 1, 10)
    events = spark.createDataFrame([("a", d, 1), ("b", d, -1)], "symbol string, date date, direction int")
    news = spark.createDataFrame([(i, s, d + dt.timedelta(k), x) for i, (s, k, x) in enumerate([("a", -4, 1.0), ("a", -3, 1.0), ("a", 0, -1.0), ("a", 2, 1.0), ("MARKET", 1, 0.0)])], "news_id int, symbol string, date date, score double")
    got = {r.symbol: (r.n_news, r.covered, r.has_signal, r.match) for r in association.matches(events, news).collect()}
    assert got == {"a": (3, True, False, False), "b": (1, True, False, False)}
    total = association.summary(association.matches(events, news), []).first()
    assert total.match_rate is None and total.coverage == 1.0
    interval = association.bootstrap(association.matches(events, news), 10, ["symbol"]).first()
    assert (interval.low, interval.high) == (0.0, 0.0)


def test_macro_f1(spark):
    rows = prepare(spark).createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "truth string, guess string")
    s = metrics.scores(metrics.confusion(rows, []), []).first()
    assert s.accuracy == 0.5 and s.macro_f1 == pytest.approx((2 / 3 + 0.5 + 0) / 3)


def test_scan_tolerates_missing_columns(spark):
    rows = prepare(spark).createDataFrame([(1, 2), (3, 4)], "a int, b int")
    assert scan(rows, ["b", "zz"], [F.col("a") > 1], [F.desc("a")], 1).collect() == [(4,)]


def test_url_lists_limits(spark, tmp_path):
    """The limit counts URLs that no earlier list gave; without one every line is read, in any number of splits."""
    lists = {"a": ["u1", "u2", "", " u1 ", "u3", "u4"], "b": ["u1", "u2", "u3", "\tu5", "u6", "u7"], "c": [f"v{i % 90}" for i in range(400)] + ["u7"]}
    for name, lines in lists.items():
        (tmp_path / f"{name}.txt").write_text("\n".join(lines))

    def expected(limit):
        out, seen = [], set()
        for name, lines in sorted(lists.items()):
            count = 0
            for place, url in enumerate(x.strip() for x in lines if x.strip()):
                if url not in seen:
                    out.append((name, place, url))
                    seen.add(url)
                    count += 1
                    if limit and count >= limit:
                        break
        return sorted(out)

    session = prepare(spark)
    before = session.conf.get("spark.sql.files.maxPartitionBytes")
    session.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        for limit in (0, 1, 2, 3):
            got = files.read_url_lists(session, str(tmp_path), new_per_file=limit, list_of=r"(\w+)\.txt")
            assert sorted((r.file, r.line, r.url) for r in got.collect()) == expected(limit)
    finally:
        session.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_percentage_of_random_places():
    random.seed(1)
    assert text.valid_paragraph("x" * 30) and not text.valid_paragraph("x" * 29)


def test_refresh_of_a_replayed_batch(spark, tmp_path):
    """A micro-batch that comes twice, or comes again after later ones, changes nothing; late days recompute what follows."""
    session, stored = prepare(spark), f"file://{tmp_path}/state"
    schema = "event_id long, ts timestamp_ntz, event_type string, value double"
    day = lambda i, d, v, s="a": (i, datetime(2026, 1, d, i % 24), s, v)
    batches = [[day(i, i + 1, float(i)) for i in range(8)], [day(30, 9, 9.0), day(31, 2, 50.0), day(32, 1, 1.0, "b")]]
    frames = [session.createDataFrame(b, schema) for b in batches]
    for k in (0, 0, 1, 0, 1):
        incremental.refresh(session, stored, frames[k], k)
    got = {(r.symbol, r.date.day): (r.close, r.n, r.ma_5) for r in incremental.daily_state(session, stored).collect()}
    close = [0.0, 50.0, *map(float, range(2, 8)), 9.0]
    assert got == {**{("a", d): (close[d - 1], 2 if d == 2 else 1, round(sum(close[d - 5 : d]) / 5, 6) if d >= 5 else None) for d in range(1, 10)}, ("b", 1): (1.0, 1, None)}


def test_shared_folder_is_refused_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master, applicationId = "yarn", "x"

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session)


def test_quantiles_of_pooled_leaves(spark):
    session = prepare(spark)
    train = session.createDataFrame([([1.0, 5.0], 1.0), ([1.0, 6.0], 2.0), ([2.0, 5.0], 10.0), ([1.0, 5.0], 1.0)], "leaf array<double>, y double")
    test = session.createDataFrame([("a", [1.0, 5.0]), ("b", [2.0, 6.0]), ("c", [9.0, 9.0])], "k string, leaf array<double>")
    got = {r.k: r.q for r in pooled_quantiles(train, test, "y", ["k"], (0.0, 0.5, 1.0)).collect()}
    assert got == {"a": [1.0, 1.0, 10.0], "b": [2.0, 6.0, 10.0]}  # a: 1 1 2 and 1 1 10; b: 10 and 2


def test_entities_are_validated_one_by_one(spark):
    rows = prepare(spark).createDataFrame([(1, '[{"entity": "VCB", "type": "stock"}, {"entity": "Vin", "type": "stock"}, {"entity": "TOOLONG", "type": "stock"}, {"entity": "SBV", "type": "org"}, {"type": "stock"}, {"entity": " ", "type": "stock"}, 7, {"entity": "X1"}]'), (2, "no list"), (3, None), (4, "[]")], "id int, entities string")
    assert [(r.id, r.entity, r.is_symbol) for r in valid_entities(rows, "entities").collect()] == [(1, "VCB", True), (1, "Vin", False), (1, "TOOLONG", False), (1, "SBV", False), (1, "X1", False)]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_moved_is_a_permutation(n):
    for repeat in (1, 2, 77):
        got = ranks.moved(np.arange(n), np.full(n, repeat), np.full(n, n))
        assert sorted(got.tolist()) == list(range(n))


def test_moved_places_are_spread_evenly():
    """Each place goes everywhere about equally often, and neighbours don't stay together."""
    n, repeats = 10, 4000
    place, repeat = np.tile(np.arange(n), repeats), np.repeat(np.arange(1, repeats + 1), n)
    got = ranks.moved(place, repeat, np.full(len(place), n)).reshape(repeats, n)
    counts = np.stack([np.bincount(got[:, k], minlength=n) for k in range(n)])
    assert abs(counts - repeats / n).max() < 5 * math.sqrt(repeats / n)
    assert len({tuple(x) for x in got.tolist()}) > 0.99 * repeats
    gaps = np.bincount((got[:, 1] - got[:, 0]) % n, minlength=n)
    assert gaps[0] == 0 and abs(gaps[1:] - repeats / (n - 1)).max() < 5 * math.sqrt(repeats / (n - 1))


def test_null_rates_are_those_of_random_permutations(spark):
    rng = random.Random(5)
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    news = [(k, rng.choice("AB"), day(rng.randrange(40)), rng.choice([-1.0, 0.5, 0.75])) for k in range(60)]
    cps = [("A", day(10), 1), ("B", day(15), -1), ("A", day(30), -1), ("B", day(33), 1)]
    found = association.permutation_rates(
        spark.createDataFrame(cps, "symbol string, date date, direction int"), spark.createDataFrame(news, "news_id long, symbol string, date date, score double"), 400).toPandas()["rate"]
    dates, rates = [d for _, _, d, _ in news], []
    for _ in range(400):
        dealt = rng.sample(dates, len(dates))
        hits = []
        for symbol, d, direction in cps:
            near = [s for (_, x, _, s), at in zip(news, dealt) if x == symbol and -association.BEFORE <= (at - d).days <= association.AFTER]
            if near and round(sum(near) / len(near), 9) != 0:
                hits.append(np.sign(sum(near)) == direction)
        rates.append(np.mean(hits) if hits else 0.0)
    assert len(found) == 400 and abs(found.mean() - np.mean(rates)) < 0.06 and abs(found.std() - np.std(rates)) < 0.05


def test_places_and_adjusted_p_values(spark):
    rng = random.Random(3)
    p = [rng.choice([0.001, 0.01, 0.2, rng.random()]) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(p)) + [(300, None)], "id long, p double").repartition(7)
    placed = ranks.placed(rows.where("p is not null"), "p", "id").orderBy("place").collect()
    assert [(r["p"], r["id"]) for r in placed] == sorted(zip(p, range(300))) and [r["place"] for r in placed] == list(range(300))
    order, want, least = sorted(zip(p, range(300))), {}, 1.0
    for k in range(299, -1, -1):
        least = min(least, order[k][0] * 300 / (k + 1))
        want[order[k][1]] = least
    assert {r["id"]: r["adjusted"] for r in ranks.adjusted(rows, "p", "id").collect()} == pytest.approx(want)
    assert ranks.adjusted(rows.limit(0), "p", "id").count() == 0


def test_adjusted_p_values_of_a_long_range(spark):
    """All tests in one range: its time grows in proportion to the rows (their square took over a minute here)."""
    n, name = 60_000, "spark.sql.shuffle.partitions"
    rows, before = spark.range(n).select("id", (F.pmod(F.col("id") * 7919, F.lit(1000)) / 1000 * 0.9 + 0.05).alias("p")), spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        began = time.monotonic()
        got = ranks.adjusted(rows, "p", "id").toPandas().sort_values(["p", "id"])
        took = time.monotonic() - began
    finally:
        spark.conf.set(name, before)
    raised = np.sort(got["p"].to_numpy()) * n / np.arange(1, n + 1)
    want = np.minimum(np.minimum.accumulate(raised[::-1])[::-1], 1)
    assert len(got) == n and got["id"].is_unique and np.allclose(got["adjusted"], want, rtol=1e-12)
    assert took < 40


def test_study_of_detected_change_points(spark):
    """Steps in returns become events; news of their signs match them, and hardly ever when dealt at random."""
    rng = np.random.default_rng(2)
    start, rows, news = dt.date(2023, 1, 1), [], []
    for symbol, sign in (("A", 1), ("B", -1), ("C", 1)):
        level = np.repeat([0.0, 1.0, 0.0, 1.0], 40) * sign
        rows += [(symbol, start + dt.timedelta(days=k), float(x + rng.normal(0, 0.05))) for k, x in enumerate(level)]
        news += [(symbol, start + dt.timedelta(days=k), float(sign * way)) for k, way in ((40, 1), (80, -1), (120, 1)) for _ in range(2)]
    news += [(s, start + dt.timedelta(days=int(k)), float(x)) for s, k, x in zip(rng.choice(list("ABC"), 60), rng.integers(10, 30, 60), rng.choice([-1, 1], 60))]
    returns = spark.createDataFrame(rows + [("A", start - dt.timedelta(days=1), None)], "symbol string, date date, value double")
    events = changepoint.detected(returns)
    got = {(r["symbol"], (r["date"] - start).days): (r["direction"], r["magnitude"]) for r in events.collect()}
    assert set(got) == {(s, k) for s in "ABC" for k in (40, 80, 120)}
    assert all(d == (1 if s != "B" else -1) * (-1 if k == 80 else 1) and abs(m - 1) < 0.1 for (s, k), (d, m) in got.items())
    table = spark.createDataFrame([(k, *x) for k, x in enumerate(news)], "news_id long, symbol string, date date, score double")
    r = association.study(events, table, 200).first()
    assert (r["n_cp"], r["n_covered"], r["n_match"], r["match_rate"], r["observed"], r["low"], r["high"]) == (9, 9, 9, 1.0, 1.0, 1.0, 1.0)
    assert 0.2 < r["null_mean"] < 0.8 and r["p_one_sided"] < 0.1
    none = association.study(events.limit(0), table, 20).first()
    assert none["n_cp"] == 0 and none["match_rate"] is None


def test_published_date_takes_the_first_place_that_parses(spark):
    cases = [
        ('<meta property="article:published_time" content="soon"><meta itemprop="datePublished" content="2026-04-14"><time datetime="2020-01-01">x</time>', dt.date(2026, 4, 14)),
        ('<meta name="DC.date.issued" content="14/04/2026">', dt.date(2026, 4, 14)),
        ("<p><time>14/04/2026 <b>21:04</b></time></p>", dt.date(2026, 4, 14)),
        ('<time datetime="2026-04-14T21:04:05">1/1/2020</time><time datetime="2020-01-01"></time>', dt.date(2026, 4, 14)),
        ('<div class="date">2020-01-01</div><div class="x post-time">- 14/04/2026 21:04<p>a<p>b</div>', dt.date(2026, 4, 14)),
        ('<span class="date">junk</span><span class="date">2020-01-01</span><i class="tbts-date">2026-04-14</i>', dt.date(2026, 4, 14)),
        ("<p>2020-01-01</p>", None), ("", None), (None, None),
    ]
    rows = prepare(spark).createDataFrame([(k, h) for k, (h, _) in enumerate(cases)], "k int, h string").select("k", text.published_date(F.col("h")).alias("d")).orderBy("k").collect()
    assert [r["d"] for r in rows] == [d for _, d in cases]


def test_months_of_a_sitemap_index(spark):
    xml = "<loc>u/news-2026-3.xml</loc><loc> u/news-2025-12.xml\n</loc><loc>u/about.xml</loc><loc>u/news-2026-11.xml</loc>"
    got = spark.createDataFrame([(xml,), (None,), ("",)], "x string").select(files.months_between(F.col("x"), "2025-12", "2026-09").alias("m")).collect()
    assert [[tuple(p) for p in r["m"] or []] for r in got] == [[("2025-12", "u/news-2025-12.xml"), ("2026-03", "u/news-2026-3.xml")], [], []]


def test_term_lists(spark, tmp_path):
    (tmp_path / "a.yml").write_text("# words\npositive:\n  - tăng\n  - 'giảm lỗ'  # of losses\n\n  # more\n  - \"lãi: cao\"\nempty:\nnegative: # bad\n- lỗ", encoding="utf-8")
    got = {(r["name"], r["place"], r["term"]) for r in files.read_term_lists(spark, str(tmp_path)).collect()}
    assert got == {("positive", 0, "tăng"), ("positive", 1, "giảm lỗ"), ("positive", 2, "lãi: cao"), ("negative", 0, "lỗ")}


def test_counted_upsert_and_updates_by_id(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    batch = spark.createDataFrame([(2, "c", 5), (None, "d", 6), (3, None, 1), (4, "e", None)], "k int, v string, t int")
    rows, counts = merge.upsert_counted(stored, batch, ["k"], ["t"], F.col("v") != "zzz")
    assert {(r.k, r.v) for r in rows.collect()} == {(1, "a"), (2, "c"), (4, "e")} and tuple(counts.first()) == (2, 2)
    assert tuple(merge.upsert_counted(stored, batch.limit(0), ["k"], ["t"], F.lit(True))[1].first()) == (0, 0)
    changes = spark.createDataFrame([(2, "x", None), (9, "y", 9)], "k int, v string, t int")
    assert sorted(tuple(r) for r in merge.updated(stored, changes, "k").collect()) == [(1, "a", 1), (2, "x", 1)]


def test_ewm_of_long_short_and_odd_series(spark):
    """One series of most rows over many ranges, short ones, a null key, nulls at the head, inside and throughout; against a plain loop."""
    rng = np.random.default_rng(11)
    rows = [("long", k, None if rng.random() < 0.1 and k != 0 else float(rng.normal())) for k in range(3000)]
    rows += [(f"s{j}", k, float(rng.normal()) if k > j else None) for j in range(40) for k in range(j % 7 + 1)] + [(None, k, float(k)) for k in range(5)] + [("empty", k, None) for k in range(3)]
    columns = {"plain": ("x", dict(alpha=0.3, adjust=False)), "adjusted": ("x", dict(com=4)), "late": ("x", dict(span=9, adjust=False, min_periods=6))}
    got = with_ewm(prepare(spark).createDataFrame(rows, "k string, at long, x double").repartition(7), columns, "k", ("at",)).toPandas()
    assert len(got) == len(rows)
    frame = pd.DataFrame(rows, columns=["k", "at", "x"])
    for (k, part), (_, mine) in zip(frame.groupby("k", dropna=False), got.groupby("k", dropna=False)):
        mine = mine.sort_values("at")
        for name, (_, how) in columns.items():
            want = part.sort_values("at")["x"].astype(float).ewm(ignore_na=True, **how).mean()
            assert np.allclose(mine[name].to_numpy(float), want.to_numpy(), rtol=1e-12, equal_nan=True), (k, name)


def test_scan_with_steps_of_any_size(spark):
    """A recurrence whose steps differ, also zero and negative ones, and batches that a series crosses."""
    rng = np.random.default_rng(12)
    a, b = rng.choice([0.0, -0.5, 0.9, 1.0], 5000), rng.normal(size=5000)
    rows = prepare(spark).createDataFrame([("one" if k < 4990 else "two", k, float(a[k]), float(b[k])) for k in range(5000)], "key string, at long, a double, b double")
    got = scan_.scan(rows, "key", ["at"], {"y": (F.col("a"), F.col("b"), None)}).orderBy("at").toPandas()
    y = 0.0
    for k in range(5000):
        y = (0.0 if k == 4990 else y) * a[k] + b[k]
        assert abs(got["y"][k] - y) < 1e-9
    assert scan_.scan(rows.limit(0), "key", ["at"], {"y": (F.col("a"), F.col("b"), None)}).count() == 0


def test_streamed_means_with_late_rows_and_a_restart(spark, tmp_path):
    """Three deliveries, rows of an earlier hour among later ones, a restart after each: the means are those of the ordered whole."""
    from tidegauge.streaming import incremental, ordered

    spark = prepare(spark)
    rng, start = np.random.default_rng(13), dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(minutes=int(k * 2)), 1, "ab"[k % 2] if k % 11 else None, None if k % 17 == 3 else float(rng.normal()), "") for k in range(240)]
    for k in range(0, 230, 9):  # late by up to half an hour
        rows[k], rows[k + 7] = rows[k + 7], rows[k]
    out = []
    for part in range(3):
        spark.createDataFrame(rows[part * 80 : part * 80 + 80], incremental.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        stream = lambda: ordered.ordered_means(incremental.source(spark, str(tmp_path)), 0.2)
        incremental.stateful(spark, ordered.PROVIDER, lambda: incremental.drained(stream(), each=lambda rows, _: out.extend(rows.collect()), checkpoint=f"file://{tmp_path}/checkpoint"))
    last = max(r[1] for r in rows)
    frame = pd.DataFrame(rows, columns=["event_id", "ts", "u", "symbol", "value", "p"]).fillna({"symbol": ""}).sort_values(["ts", "event_id"])
    frame["mean"] = frame.groupby("symbol")["value"].transform(lambda x: x.astype(float).ewm(alpha=0.2, adjust=False, ignore_na=True).mean())
    frame = frame[frame["ts"].dt.floor("h") + pd.Timedelta("1h") <= last - pd.Timedelta("1h")]
    want = {r.event_id: (r.symbol, r.mean) for r in frame.itertuples()}
    got = {r.event_id: (r.symbol, r.mean) for r in out}
    assert len(out) == len(got) == len(want) > 150 and set(got) == set(want)
    for k, (symbol, mean) in want.items():
        assert got[k][0] == symbol and (got[k][1] is None if np.isnan(mean) else abs(got[k][1] - mean) < 1e-9)


def test_streamed_means_of_one_long_series(spark, tmp_path):
    """The key's state is its mean, its rows wait by hour; rows behind the watermark count while their hour isn't over; odd rows."""
    from tidegauge.streaming import incremental, ordered

    spark = prepare(spark)
    rng, start = np.random.default_rng(17), dt.datetime(2024, 1, 1)
    rows = [(int(rng.integers(2**60)), start + dt.timedelta(seconds=int(s)), 1, "a", float(rng.normal()), "") for s in rng.integers(0, 40_000, 20_000)]  # many at the same second
    rows = [(*r[:4], None, "") if r[1].hour in (0, 5) else r for r in rows]  # hours without values, the first one too
    rows += [(None, start + dt.timedelta(minutes=61), 1, "a", 2.0, ""), (-1, None, 1, "a", 9.0, ""), (7, start, 1, None, None, "")]
    end = max(r[1] for r in rows if r[1])
    late = [(8, (end - dt.timedelta(hours=1)).replace(minute=0, second=0), 1, "a", 5.0, ""), (9, start, 1, "a", 5.0, ""), (10, end + dt.timedelta(hours=3), 1, "a", 5.0, "")]
    out, operators = [], []
    for part in (rows, late):
        spark.createDataFrame(part, incremental.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))

        def run():
            stream = ordered.ordered_means(incremental.source(spark, str(tmp_path)), 0.2).writeStream.trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/checkpoint")
            query = stream.foreachBatch(lambda rows, _: out.extend(rows.collect())).start()
            query.awaitTermination()
            operators.extend(o for p in query.recentProgress for o in p.stateOperators)

        incremental.stateful(spark, ordered.PROVIDER, run)
    assert max(o.numRowsTotal for o in operators) >= 12  # hours that wait apart
    assert max(o.numRowsTotal for o in operators if o.operatorName.startswith("transformWithState")) <= 2
    whole = [r for r in rows + late if r[1] and r[0] != 9]  # 9 came when its hour was over
    frame = pd.DataFrame(whole, columns=["event_id", "ts", "u", "symbol", "value", "p"]).fillna({"symbol": ""})
    frame = frame.assign(event_id=pd.array([r[0] for r in whole], "Int64")).sort_values(["ts", "event_id"])
    frame["mean"] = frame.groupby("symbol")["value"].transform(lambda x: x.astype(float).ewm(alpha=0.2, adjust=False, ignore_na=True).mean())
    frame = frame[frame["event_id"].ne(10).fillna(True)]
    want = {None if pd.isna(r.event_id) else r.event_id: (r.symbol, r.value, r.mean) for r in frame.itertuples()}
    got = {r.event_id: (r.symbol, r.value, r.mean) for r in out}
    assert len(out) == len(frame) and set(got) == set(want) and {8, None, 7} <= set(got)
    for k, (symbol, value, mean) in want.items():
        assert got[k][0] == symbol and all(x is None if np.isnan(y) else abs(x - y) < 1e-9 for x, y in zip(got[k][1:], (value, mean)))


def test_dictionary_matches_are_those_of_a_pattern(spark, monkeypatch):
    """Random texts against alternatives sorted by length; blocks of terms give the same; nulls, empty texts and dictionaries."""
    import random
    import re

    from tidegauge.functions import automaton

    rng = random.Random(3)
    terms = sorted({"".join(rng.choice("ab é") for _ in range(rng.randint(1, 5))).strip() for _ in range(40)} - {""}) + ["İx", "a.b", "A B"]
    texts = ["".join(rng.choice("abAB éÉ._ İ") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "a" * 50_000]
    frame = prepare(spark).createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    pattern = re.compile(r"(?<!\w)(" + "|".join(re.escape(t) for t in sorted({automaton.folded(t) for t in terms}, key=lambda t: (-len(t), t))) + r")(?!\w)")
    want = {k: [(m.start(), m.end(), m.group()) for m in pattern.finditer(automaton.folded(t or ""))] for k, t in enumerate(texts)}
    assert sum(map(len, want.values())) > 300
    for chars in (automaton.BLOCK_CHARS, 12):
        monkeypatch.setattr(automaton, "BLOCK_CHARS", chars)
        assert (len(automaton.prepared(terms)) > 1) == (chars == 12)
        got = {r.k: [tuple(h) for h in r.h] for r in frame.select("k", automaton.matches(F.col("t"), terms).alias("h")).collect()}
        assert got == want
    assert frame.select(F.size(automaton.matches(F.col("t"), [None, " "])).alias("n")).agg(F.max("n")).first()[0] == 0
    rows = spark.createDataFrame([("x", "one"), ("x", ""), (None, "two"), ("y", "three")], "name string, term string")
    assert automaton.dictionary(rows) == {"x": ["one"], "y": ["three"]}
    monkeypatch.setattr(automaton, "MOST_CHARS", 3)
    with pytest.raises(ValueError):
        automaton.dictionary(rows)


def test_folded_articles_are_those_of_the_parser(spark):
    """All pages, and pages that nest, break off and leave elements open: the fold against the HTML parser."""
    from tidegauge.functions import markup

    long = "words that are long enough to be a paragraph of text"
    odd = [
        None, "", "plain text only", f"<p>{long}", f"<P CLASS='x'>{long}<p>{long} two</P></p>", f"<div class=\"a>b menu\"><p>{long}</p></div><p>{long} &amp;amp; &lt;b&gt;</p>", f"<nav><div></nav><p>{long}</p></div>",
        f"<header><p>{long}</header><p>{long} 2", f"<script>if (a<b) '<p>{long}</p>'</script><style>p{{}}</style><p>{long}</p>", f"<!-- <p>{long}</p> --><p>{long} x<!-- y --> z</p>", f"<h1>One <i>two</i></h1><h1>three</h1><p>{long}<br/>after<br>more</p></section>",
        f"<div id=share><p>{long}</p></div></div></div><p>{long}</p>", f"<ul><li><p>{long}<li>{long}</ul>{long}", f"<p>{long} é ü — «x» &nbsp;y</p><figure><p>{long}</p>", f"<meta name=description content='short &quot;q&quot;'><p>{long}</p>",
    ]
    pages = prepare(spark).createDataFrame([(k, h) for k, h in enumerate(odd)], "page_id long, html string").unionByName(spark.read.parquet(f"{DATA}/pages.parquet").select(F.col("page_id") + 1000, "html").toDF("page_id", "html"))
    want = {r.page_id: r for r in pages.select("page_id", text.article("html").alias("a")).select("page_id", "a.*").collect()}
    got = {r.page_id: r for r in markup.articles(pages).collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert (got[k].title, got[k].summary, got[k].content, got[k].paragraphs) == (r.title, r.summary, r.content, r.paragraphs), k

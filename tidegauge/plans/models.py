"""Splits, grid searches, classification metrics and volatility models."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import text
from tidegauge.functions.windows import W, YEAR, frame, full, garman_klass, log_change, parkinson
from tidegauge.operators import boosting, least_squares, metrics
from tidegauge.operators.ewm import with_ewm
from tidegauge.plans import indicators
from tidegauge.plans.texts import _NET, _net
from tidegauge.shared import written
from tidegauge.sources.adapters import NEWS, bars, news, table

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


_GOLD = f"""{NEWS}, {_NET}, gold as (select n.news_id, n.score, n.pos - n.neg as net, case when toxic = 1 then 'negative' when quality = 1 then 'positive' else 'neutral' end as truth from net n join labels l on l.doc_id = n.news_id),
  parts as (select *, row_number() over (partition by truth order by md5('split:' || news_id), news_id) <= floor(0.7 * count(*) over (partition by truth)) as train from gold)"""


def _gold(spark, sf_dir) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("news_id"), "quality", "toxic")
    rows = _net(news(spark, sf_dir)).join(labels, "news_id")
    truth = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return rows.select("news_id", "score", (F.col("pos") - F.col("neg")).alias("net"), truth.alias("truth"))


def stratified(rows: DataFrame, label: str, key: str, share: float, buckets: int = 256) -> DataFrame:
    """``rows`` with ``train``: in each class the first ``share`` in the order of a digest of the key.

    Places are counted inside buckets of the digest, after sums over the buckets:
    a class with most of the rows is no single task.
    """
    rows = rows.withColumn("_h", F.md5(F.concat(F.lit("split:"), F.col(key).cast("string")))).withColumn("_b", F.conv(F.substring("_h", 1, 2), 16, 10).cast("int") % buckets)
    sums = rows.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(label, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(label)).alias("_all"))
    place = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)) + F.col("_before")
    return rows.join(sums, [label, "_b"]).withColumn("train", place <= F.floor(F.lit(share) * F.col("_all"))).drop("_h", "_b", "_before", "_all")


@query(f"with {_GOLD} select news_id, truth, train from parts")
def stratified_split(spark, sf_dir):
    return stratified(_gold(spark, sf_dir), "truth", "news_id", 0.7).select("news_id", "truth", "train")


_F1 = "2 * count(*) filter (where truth = guess and truth = '{c}') / nullif(count(*) filter (where truth = '{c}') + count(*) filter (where guess = '{c}'), 0)::double"


def _macro_sql(classes) -> str:
    """Mean F1 over classes that occur in truth or guess."""
    each = [_F1.format(c=c) for c in classes]
    return "(" + " + ".join(f"coalesce({e}, 0)" for e in each) + ") / (" + " + ".join(f"case when {e} is null then 0 else 1 end" for e in each) + ")::double"


# The grids that are searched.
ALPHAS, KS, TAUS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8), (0.4, 0.6, 0.8, 1.0), (0.05, 0.1, 0.15, 0.2, 0.25, 0.3)

_CELLS = f"""{_GOLD}, g as (select alpha, k, truth, case when (1 - alpha) * score + alpha * tanh(k * net) > 0 then 'positive' else 'negative' end as guess from parts, (select unnest({list(ALPHAS)})::double as alpha) a, (select unnest({list(KS)})::double as k) b where train and truth <> 'neutral'),
  cells as (select alpha, k, round({_macro_sql(('positive', 'negative'))}, 6) as macro_f1, count(*) as n from g group by alpha, k), best as (select * from cells order by macro_f1 desc, alpha, k limit 1)"""


def _hybrid(alpha, k):
    return (1 - alpha) * F.col("score") + alpha * F.tanh(k * F.col("net"))


def _cells(spark, sf_dir) -> DataFrame:
    """Binary macro F1 of every (alpha, k): a small grid per row, one aggregation."""
    train = stratified(_gold(spark, sf_dir), "truth", "news_id", 0.7).where("train and truth <> 'neutral'")
    grid = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(k).alias("k")) for a in ALPHAS for k in KS])
    rows = train.select("truth", "score", "net", F.explode(grid).alias("g")).select("truth", "score", "net", "g.*")
    found = metrics.scores(metrics.confusion(rows.withColumn("guess", text.polarity(_hybrid(F.col("alpha"), F.col("k")))), ["alpha", "k"]), ["alpha", "k"])
    return found.select("alpha", "k", F.round("macro_f1", 6).alias("macro_f1"), "n")


def _best(spark, sf_dir) -> DataFrame:
    return _cells(spark, sf_dir).orderBy(F.desc("macro_f1"), "alpha", "k").limit(1)


@query(f"with {_CELLS} select * from cells")
def grid_cells_alpha_k(spark, sf_dir):
    return _cells(spark, sf_dir)


@query(f"with {_CELLS} select * from best")
def grid_search_alpha_k(spark, sf_dir):
    """The first (alpha, k) in the grid's order with the best binary macro F1."""
    return _best(spark, sf_dir)


@query(f"""with {_CELLS}, h as (select tau, truth, case when s > tau then 'positive' when s < -tau then 'negative' else 'neutral' end as guess from (select truth, (1 - alpha) * score + alpha * tanh(k * net) as s from parts, best where train), (select unnest({list(TAUS)})::double as tau) t),
  r as (select tau, {_macro_sql(('positive', 'negative', 'neutral'))} as f1 from h group by tau) select tau, round(f1, 6) as macro_f1 from r order by round(f1, 6) desc, tau limit 1""")
def grid_search_tau(spark, sf_dir):
    """The first neutral half-width with the best three-class macro F1, at the best (alpha, k)."""
    train = stratified(_gold(spark, sf_dir), "truth", "news_id", 0.7).where("train")
    one = F.broadcast(_best(spark, sf_dir).select("alpha", "k"))  # a single row
    rows = train.join(one).select("truth", _hybrid(F.col("alpha"), F.col("k")).alias("s"), F.explode(F.array(*map(F.lit, TAUS))).alias("tau"))
    guess = F.when(F.col("s") > F.col("tau"), "positive").when(F.col("s") < -F.col("tau"), "negative").otherwise("neutral")
    found = metrics.scores(metrics.confusion(rows.withColumn("guess", guess), ["tau"]), ["tau"])
    return found.select("tau", F.round("macro_f1", 6).alias("macro_f1")).orderBy(F.desc("macro_f1"), "tau").limit(1)


_TEST = f"{_GOLD}, test as (select truth, case when s > 0.1 then 'positive' when s < -0.1 then 'negative' else 'neutral' end as guess from (select truth, 0.4::double * score + 0.6::double * tanh(0.8::double * net) as s from parts where not train))"


def _test(spark, sf_dir):
    rows = stratified(_gold(spark, sf_dir), "truth", "news_id", 0.7).where("not train")
    return metrics.confusion(rows.withColumn("guess", text.three_classes(text.hybrid(F.col("score"), F.col("net")))), [])


@query(f"with {_TEST} select truth, guess, count(*) as n from test group by 1, 2")
def confusion_matrix(spark, sf_dir):
    return _test(spark, sf_dir)


@query(f"with {_TEST} select round(avg(case when truth = guess then 1.0::double else 0 end), 6) as accuracy, round({_macro_sql(('positive', 'negative', 'neutral'))}, 6) as macro_f1, count(*) as n from test")
def macro_f1(spark, sf_dir):
    return metrics.scores(_test(spark, sf_dir), []).select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"), "n")


@query(f"""with {_TEST}, c as (select unnest(['positive', 'negative', 'neutral']) as label)
  select label, round(coalesce(count(*) filter (where truth = label and guess = label) / nullif(count(*) filter (where guess = label), 0)::double, 0), 6) as "precision", round(coalesce(count(*) filter (where truth = label and guess = label) / nullif(count(*) filter (where truth = label), 0)::double, 0), 6) as recall,
  count(*) filter (where truth = label) as support from test, c group by label having count(*) filter (where truth = label or guess = label) > 0""")
def class_report(spark, sf_dir):
    return metrics.per_class(_test(spark, sf_dir), []).select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "support")


FEATURES = ("rv_d", "rv_w", "rv_m", "parkinson_vol", "gk_vol", "amihud", "rsi_14", "macd", "macd_signal", "macd_hist", "atr_14", "bb_bw", "close_lag1", "volume_lag1", "volume_ma5", "day_of_week", "month", "symbol_enc")
HAR = ("rv_d", "rv_w", "rv_m")
CUTOFF, VALIDATION = "2000-01-01", "1999-01-01"
#: Trees of a forest and their depth; rounds of boosting, depth and step. The reference's are 500, no limit; 800, 6, 0.05.
TREES, DEPTH, ROUNDS, ROUND_DEPTH, STEP = 100, 10, 40, 6, 0.05


def panel(b: DataFrame) -> DataFrame:
    """Features known at a day's close and the volatility of the five days after it; rows with all of them."""
    c, o, h, low, v = (F.col(x) for x in ("close", "open", "high", "low", "volume"))
    codes = b.select("symbol").distinct().withColumn("symbol_enc", F.dense_rank().over(Window.orderBy("symbol")) - 1)
    move, pc = c - F.lag(c).over(W()), F.lag(c).over(W())
    moved = b.withColumns({"gain": F.greatest(move, F.lit(0.0)), "loss": F.greatest(-move, F.lit(0.0)), "tr": F.greatest(h - low, F.abs(h - pc), F.abs(low - pc))})
    wilder, ema = dict(alpha=1 / 14, adjust=False, min_periods=14), lambda span: dict(span=span, adjust=False)
    e = with_ewm(moved, {"e12": ("close", ema(12)), "e26": ("close", ema(26)), "macd_signal": ("e12 - e26", ema(9)), "up": ("gain", wilder), "down": ("loss", wilder), "atr_14": ("tr", dict(com=13, min_periods=14))})
    e = e.withColumn("macd", F.col("e12") - F.col("e26")).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    rsi = F.when(F.col("down") == 0, 100.0).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(F.col("up"), F.col("down"))))
    r = e.withColumn("rsi_14", rsi).withColumn("lr", log_change(c)).withColumn("rv", F.abs("lr") * F.sqrt(F.lit(float(YEAR)))).join(codes, "symbol")
    rv, sd = F.col("rv"), full(F.stddev_samp, c, frame(20), 20)
    return r.select(
        "symbol", "date", F.lag(rv).over(W()).alias("rv_d"), full(F.avg, rv, frame(5, 1), 5).alias("rv_w"), full(F.avg, rv, frame(22, 1), 22).alias("rv_m"),
        parkinson(h, low).alias("parkinson_vol"), F.coalesce(garman_klass(o, h, low, c), F.lit(0.0)).alias("gk_vol"), F.try_divide(F.abs("lr"), v * c).alias("amihud"), "rsi_14", "macd", "macd_signal", "macd_hist", "atr_14", F.try_divide(4 * sd, full(F.avg, c, frame(20), 20)).alias("bb_bw"),
        F.lag(c).over(W()).alias("close_lag1"), F.lag(v).over(W()).alias("volume_lag1"), full(F.avg, v, frame(5, 1), 5).alias("volume_ma5"), F.weekday("date").alias("day_of_week"), F.month("date").alias("month"), "symbol_enc",
        (full(F.stddev_samp, F.col("lr"), W().rowsBetween(1, 5), 5) * F.sqrt(F.lit(float(YEAR)))).alias("rv5_fwd"),
    ).replace(float("nan"), None).na.drop()


def _parts(spark, sf_dir, features):
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(panel(bars(spark, sf_dir)))
    return rows.where(F.col("date") < CUTOFF), rows.where(F.col("date") >= CUTOFF)


def _fit(spark, sf_dir, features, regressor):
    train, test = _parts(spark, sf_dir, features)
    model = Pipeline(stages=[regressor]).fit(train)
    return model, model.transform(test)


def evaluated(predictions: DataFrame, name: str) -> DataFrame:
    gap = F.col("rv5_fwd") - F.col("prediction")
    a = predictions.agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), (1 - F.try_divide(F.sum(gap * gap), F.var_pop("rv5_fwd") * F.count("*"))).alias("r2"), F.count("*").alias("n"))
    return a.select(F.lit(name).alias("model"), *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "r2")], "n")


def _forest(**more):
    return RandomForestRegressor(featuresCol="features", labelCol="rv5_fwd", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=20, featureSubsetStrategy="sqrt", seed=42, **more)


@query(None)
def har_ols(spark, sf_dir):
    return evaluated(_fit(spark, sf_dir, HAR, LinearRegression(featuresCol="features", labelCol="rv5_fwd", solver="normal"))[1], "har_ols")


@query(None)
def random_forest(spark, sf_dir):
    return evaluated(_fit(spark, sf_dir, FEATURES, _forest())[1], "random_forest")


@query(None)
def gradient_boosting(spark, sf_dir):
    """Boosted trees that stop early on the last year before the cutoff, not on the test rows."""
    train, test = _parts(spark, sf_dir, FEATURES)
    train = train.withColumn("held", F.col("date") >= VALIDATION)
    model = GBTRegressor(featuresCol="features", labelCol="rv5_fwd", maxIter=ROUNDS, maxDepth=ROUND_DEPTH, stepSize=STEP, seed=42, validationIndicatorCol="held").fit(train)
    return evaluated(model.transform(test), "gradient_boosting")


#: Rounds of the registered queries; the whole number is in ``boosting.Settings``. Rounds without a better error on the last year before the cutoff that end a boosting.
BOOSTED, PATIENCE = 6, 50


def boosted(spark, sf_dir, settings: boosting.Settings, name: str) -> DataFrame:
    """Boosting with row and column draws and both penalties, stopped by the last year before the cutoff, not by the test rows."""
    rows = written(panel(bars(spark, sf_dir)))
    train = rows.where(F.col("date") < CUTOFF).withColumn("held", F.col("date") >= VALIDATION)
    model = boosting.fit(train, list(FEATURES), "rv5_fwd", ["symbol", "date"], "held", settings)
    return evaluated(boosting.predicted(rows.where(F.col("date") >= CUTOFF), model, ["rv5_fwd"]), name)


@query(None)
def boosted_levels(spark, sf_dir):
    """Trees by whole levels, six deep."""
    return boosted(spark, sf_dir, boosting.Settings(rounds=BOOSTED, patience=PATIENCE), "boosted_levels")


@query(None)
def boosted_leaves(spark, sf_dir):
    """Trees of the best 63 leaves, six deep, with 20 rows a leaf at least."""
    return boosted(spark, sf_dir, boosting.Settings(rounds=BOOSTED, leaves=63, least=20, patience=PATIENCE), "boosted_leaves")


@query(None)
def feature_importance(spark, sf_dir):
    """The ten features that the forest uses most."""
    model, _ = _fit(spark, sf_dir, FEATURES, _forest())
    weights = model.stages[0].featureImportances.toArray()
    rows = [(n, round(float(w), 6)) for n, w in zip(FEATURES, weights)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(10)


def pooled_quantiles(train: DataFrame, test: DataFrame, target: str, keys: list[str], shares: tuple[float, ...]) -> DataFrame:
    """(keys, q): quantiles of all training targets in the leaves (an array, a leaf per tree) that each test row falls into."""
    leaves = lambda rows, *keep: rows.select(*keep, F.posexplode("leaf").alias("tree", "at"))
    # a leaf is its distinct targets with their counts, so that what meets a test row is summed up before
    held = leaves(train, F.col(target).alias("y")).groupBy("tree", "at", "y").agg(F.count("*").alias("n"))
    return leaves(test, *keys).join(held, ["tree", "at"]).groupBy(*keys).agg(F.percentile("y", F.array(*map(F.lit, shares)), F.col("n")).alias("q"))


@query(None)
def quantile_forest(spark, sf_dir):
    """P10, P50 and P90 per test row, of the training targets in all leaves that it falls into; and their coverage."""
    train, test = _parts(spark, sf_dir, FEATURES)
    model = _forest(leafCol="leaf").fit(train)
    train, test = (model.transform(rows).withColumn("leaf", vector_to_array("leaf")) for rows in (train, test))
    found = pooled_quantiles(train, test, "rv5_fwd", ["symbol", "date", "rv5_fwd"], (0.1, 0.5, 0.9))
    found = found.select("symbol", "date", "rv5_fwd", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((10, 50, 90))])
    return found.select("symbol", "date", *[F.round(f"p{p}", 4).alias(f"p{p}") for p in (10, 50, 90)], F.col("rv5_fwd").between(F.col("p10"), F.col("p90")).alias("covered"))


@query("""with d as (select cast(o_orderdate as date) as date, count(*) as n from orders group by 1), r as (select *, row_number() over (order by date) - 1 as k, count(*) over () as m from d), f as (select fold, m // 6 as step, m from (select unnest([1, 2, 3, 4, 5]) as fold), (select count(*) as m from d))
  select cast(fold as integer) as fold, count(*) filter (where k < f.m - (6 - fold) * step - 5) as train_days, count(*) filter (where k >= f.m - (6 - fold) * step and k < f.m - (5 - fold) * step) as test_days from r, f group by fold""")
def time_folds(spark, sf_dir):
    """Five expanding folds by date with a gap of five days; a row per trading day."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    r = days.withColumn("k", F.row_number().over(Window.orderBy("date")) - 1).withColumn("m", F.count("*").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    r = r.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("step", F.floor(F.col("m") / 6))
    start = F.col("m") - (6 - F.col("fold")) * F.col("step")
    return r.groupBy("fold").agg(F.count_if(F.col("k") < start - 5).alias("train_days"), F.count_if((F.col("k") >= start) & (F.col("k") < start + F.col("step"))).alias("test_days"))


_HAR_ROWS = f"(select * from ({indicators.QUERIES['har_panel'][1]}) join ({indicators.QUERIES['rv_target_fwd'][1]}) using (symbol, date) where rv_d is not null and rv_w is not null and rv_m is not null and target is not null)"


def _det(m: list[list[str]]) -> str:
    """A determinant of three columns, written out."""
    return " + ".join(f"{sign}({m[0][a]}) * (({m[1][b]}) * ({m[2][c]}) - ({m[1][c]}) * ({m[2][b]}))" for a, b, c, sign in ((0, 1, 2, ""), (1, 0, 2, "-1 * "), (2, 0, 1, "")))


def _cramer(k: int) -> str:
    cells = [[f"c{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    swapped = [[f"y{i}" if j == k else cells[i][j] for j in range(3)] for i in range(3)]
    return f"({_det(swapped)}) / nullif({_det(cells)}, 0)"


_HAR_SUMS = ", ".join([f"covar_pop({HAR[i]}, {HAR[j]}) as c{i}{j}" for i in range(3) for j in range(i, 3)] + [f"covar_pop({h}, target) as y{i}" for i, h in enumerate(HAR)] + [f"avg({h}) as m{i}" for i, h in enumerate(HAR)] + ["avg(target) as my", "var_pop(target) as vy", "count(*) as n"])


@query(f"""with g as (select symbol, {_HAR_SUMS} from {_HAR_ROWS} where date < date '{CUTOFF}' group by symbol), b as (select *, {", ".join(f"{_cramer(k)} as b{k}" for k in range(3))} from g),
  i as (select *, my - b0 * m0 - b1 * m1 - b2 * m2 as b from b),
  e as (select r.symbol, count(*) as tested, avg(abs(target - b - b0 * rv_d - b1 * rv_w - b2 * rv_m)) as mae, sqrt(avg(pow(target - b - b0 * rv_d - b1 * rv_w - b2 * rv_m, 2))) as rmse from {_HAR_ROWS} r join i on i.symbol = r.symbol where r.date >= date '{CUTOFF}' group by 1)
  select symbol, n, round(b, 5) as intercept, round(b0, 5) as rv_d, round(b1, 5) as rv_w, round(b2, 5) as rv_m, round((b0 * y0 + b1 * y1 + b2 * y2) / vy, 5) as r2, tested, round(mae, 5) as mae, round(rmse, 5) as rmse from i left join e using (symbol)""")
def har_by_symbol(spark, sf_dir):
    """A regression per symbol of the next days' volatility on the last day's, week's and month's, from sums alone; errors after the cutoff."""
    rows = indicators.QUERIES["har_panel"][0](spark, sf_dir).join(indicators.QUERIES["rv_target_fwd"][0](spark, sf_dir), ["symbol", "date"]).na.drop(subset=[*HAR, "target"])
    rows = written(rows.select("symbol", "date", *HAR, "target"))
    fit = least_squares.solved(least_squares.gram(rows.where(F.col("date") < CUTOFF), list(HAR), "target", ["symbol"]), list(HAR), ["symbol"])
    fit = fit.withColumnsRenamed({h: f"b_{h}" for h in HAR})
    gap = F.col("target") - F.col("intercept") - sum((F.col(f"b_{h}") * F.col(h) for h in HAR), F.lit(0.0))
    errors = rows.where(F.col("date") >= CUTOFF).join(fit, "symbol")
    errors = errors.groupBy("symbol").agg(F.count("*").alias("tested"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"))
    out = fit.join(errors, "symbol", "left")
    return out.select("symbol", "n", F.round("intercept", 5).alias("intercept"), *[F.round(f"b_{h}", 5).alias(h) for h in HAR], F.round(1 - F.try_divide("rss", "tss"), 5).alias("r2"), "tested", F.round("mae", 5).alias("mae"), F.round("rmse", 5).alias("rmse"))

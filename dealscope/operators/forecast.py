"""Forecasts (F8-F11, I17): one small model per (series, origin) group, so all origins of all series run in parallel."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import period_end
from ..plans.roles import Book
from .kpi import conversion_monthly, forecast_metrics
from .series import _I, interpolate, monthly

book = Book()
#: points held out, and season length, by granularity
TEST = {"month": 12, "quarter": 4, "year": 3}
SEASON = {"month": 12, "quarter": 4, "year": 1}
HORIZON = {"month": 60, "quarter": 20, "year": 5}


def autoregressive(y: np.ndarray, season: int, steps: int, orders=(1, 2, 3)) -> tuple[np.ndarray, float]:
    """Least squares on p lags and one seasonal lag, p by AIC; predictions feed the next lags. Also the residual deviation."""
    best = None
    for p in orders:
        for lags in ([*range(1, p + 1)], [*range(1, p + 1), season] if season > p else None):
            if lags is None or len(y) - max(lags) < len(lags) + 3:
                continue
            m = max(lags)
            x = np.stack([np.ones(len(y) - m), *(y[m - k : len(y) - k] for k in lags)], axis=1)
            w, *_ = np.linalg.lstsq(x, y[m:], rcond=None)
            rss = float(((y[m:] - x @ w) ** 2).sum())
            aic = len(x) * math.log(max(rss, 1e-12) / len(x)) + 2 * len(w)
            if best is None or aic / len(x) < best[0]:
                best = aic / len(x), lags, w, math.sqrt(rss / max(len(x) - len(w), 1))
    if best is None:
        return np.full(steps, y[-1]), float(y.std())
    _, lags, w, sd = best
    out = list(y)
    low, high = y.min() - 3 * np.ptp(y), y.max() + 3 * np.ptp(y)
    for _ in range(steps):
        out.append(float(np.clip(w[0] + sum(c * out[-k] for c, k in zip(w[1:], lags)), low, high)))
    return np.array(out[len(y) :]), sd


def seasonal_trend(y: np.ndarray, season: int, steps: int, terms: int = 3) -> tuple[np.ndarray, float]:
    """Linear trend and yearly Fourier terms (none for yearly series)."""
    k = min(terms, season // 2, max((len(y) - 3) // 2, 0)) if season > 1 else 0
    t = np.arange(len(y) + steps)
    x = np.stack([np.ones(len(t)), t / max(len(y), 1), *(f(2 * np.pi * (j + 1) * t / season) for j in range(k) for f in (np.sin, np.cos))], axis=1)
    w, *_ = np.linalg.lstsq(x[: len(y)], y, rcond=None)
    return x[len(y) :] @ w, float(np.sqrt(((y - x[: len(y)] @ w) ** 2).sum() / max(len(y) - x.shape[1], 1)))


def boosted_lags(y: np.ndarray, season: int, steps: int, lags: int = 4, rounds: int = 60, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Boosted stumps on the last values and the place in the season, predictions feed the next lags."""
    m = min(lags, max(len(y) // 3, 1))
    rows = lambda v, at: np.array([*(v[at - k] for k in range(1, m + 1)), at % season], float)
    if len(y) - m < 4:
        return np.full(steps, y[-1]), float(y.std())
    x = np.stack([rows(y, i) for i in range(m, len(y))])
    goal, base, stumps = y[m:], float(y[m:].mean()), []
    fit = np.full(len(goal), base)
    for _ in range(rounds):
        r, best = goal - fit, None
        for c in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[:, c], np.linspace(0.1, 0.9, 9))):
                left = x[:, c] <= cut
                if left.all() or not left.any():
                    continue
                a, b = r[left].mean(), r[~left].mean()
                gain = a * a * left.sum() + b * b * (~left).sum()
                if best is None or gain > best[0]:
                    best = gain, c, cut, a, b
        if best is None:
            break
        _, c, cut, a, b = best
        stumps.append((c, cut, a * rate, b * rate))
        fit += np.where(x[:, c] <= cut, a * rate, b * rate)
    out = list(y)
    for i in range(len(y), len(y) + steps):
        v = rows(out, i)
        out.append(base + sum(a if v[c] <= cut else b for c, cut, a, b in stumps))
    return np.array(out[len(y) :]), float((goal - fit).std())


MODELS = {"ar": autoregressive, "trend": seasonal_trend, "boosted": boosted_lags}


def predict(y: np.ndarray, model: str, season: int, steps: int) -> tuple[np.ndarray, float]:
    """A history with one distinct value is not fitted: it repeats."""
    if len(np.unique(y)) == 1:
        return np.full(steps, y[-1]), 0.0
    return MODELS[model](y, season, steps)


class RunningProducts:
    """Least squares on growing histories: running sums of x x', x y and y y from row ``start`` on, so that an origin costs a small solve instead of a refit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, start: int = 0):
        self.start, x, y = start, x[start:], y[start:]
        self.xx, self.xy, self.yy = np.cumsum(x[:, :, None] * x[:, None, :], axis=0), np.cumsum(x * y[:, None], axis=0), np.cumsum(y * y)

    def before(self, at: int, columns: int | None = None) -> tuple[np.ndarray, float, int]:
        """Weights of the first columns from the rows before ``at``, their residual sum of squares, and the rows."""
        n = at - self.start
        a, b = self.xx[n - 1][:columns, :columns], self.xy[n - 1][:columns]
        scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
        w = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=None)[0] / scale
        return w, max(float(self.yy[n - 1] - 2 * w @ b + w @ a @ w), 0.0), n


def rolling_predictions(y: np.ndarray, model: str, season: int, origins) -> list[float]:
    """The value at each origin from all values before it, as ``predict`` gives it with one step."""
    t, unit = np.arange(len(y)), max(float(np.abs(y).max()), 1e-300)
    v = y / unit
    if model == "trend":
        k = min(3, season // 2) if season > 1 else 0
        x = np.stack([np.ones(len(y)), t / max(len(y), 1), *(f(2 * np.pi * (j + 1) * t / season) for j in range(k) for f in (np.sin, np.cos))], axis=1)
        sums = RunningProducts(x, v)
    if model == "ar":
        lag_sets = [lags for p in (1, 2, 3) for lags in ([*range(1, p + 1)], [*range(1, p + 1), season] if season > p else None) if lags]
        fits = []
        for lags in lag_sets:
            x = np.stack([np.ones(len(y)), *(np.concatenate([np.zeros(min(k, len(v))), v[:-k]])[: len(v)] for k in lags)], axis=1)
            if len(y) > max(lags):
                fits.append((lags, x, RunningProducts(x, v, max(lags))))
    out = []
    for at in origins:
        past = v[:at]
        if (past == past[0]).all():
            out.append(past[-1])
        elif model == "trend":
            n = 2 + 2 * min(k, max((at - 3) // 2, 0))
            out.append(float(x[at, :n] @ sums.before(at, n)[0]))
        elif model == "ar":
            best = None
            for lags, x, run in fits:
                if at - max(lags) < len(lags) + 3:
                    continue
                w, rss, n = run.before(at)
                score = (n * math.log(max(rss * unit * unit, 1e-12) / n) + 2 * len(w)) / n
                if best is None or score < best[0]:
                    best = score, float(x[at] @ w)
            low, high = past.min() - 3 * np.ptp(past), past.max() + 3 * np.ptp(past)
            out.append(past[-1] if best is None else float(np.clip(best[1], low, high)))
        else:
            out.append(float(predict(y[:at], model, season, 1)[0][0]) / unit)
    return [p * unit for p in out]


def rolling_origin(df: DataFrame, models=tuple(MODELS), test: int = 12, season: int = 12, key: str = "s", order: str = "p", value: str = "y") -> DataFrame:
    """(series, model, p, y, pred): each of the last ``test`` points predicted from all history before it. A task holds one series at a time, once for all its origins and models."""
    kind = dict(df.dtypes)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("p")
        y = part["y"].to_numpy()
        origins = range(max(1, len(y) - test), len(y))
        made = [pd.DataFrame({"series": part["series"].iloc[0], "model": m, "p": part["p"].to_numpy()[origins.start :], "y": y[origins.start :], "pred": rolling_predictions(y, m, season, origins)}) for m in models]
        return pd.concat(made)

    rows = df.select(F.col(key).alias("series"), F.col(order).alias("p"), F.col(value).cast("double").alias("y"))
    return rows.groupBy("series").applyInPandas(one, f"series {kind[key]}, model string, p {kind[order]}, y double, pred double")


def recursive(df: DataFrame, models=tuple(MODELS), granularity: str = "month", horizon: int | None = None, key: str = "s", order: str = "p", value: str = "y") -> DataFrame:
    """(series, model, p, pred, lo, hi): future period ends of every series; each prediction feeds the next; bands of 1.96 deviations of the one-step errors."""
    steps = horizon or HORIZON[granularity]
    season = SEASON[granularity]
    months = {"month": 1, "quarter": 3, "year": 12}[granularity]
    kind = dict(df.dtypes)[key]

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("p")
        name, model = part["series"].iloc[0], part["model"].iloc[0]
        pred, sd = predict(part["y"].to_numpy(), model, season, steps)
        return pd.DataFrame({"series": name, "model": model, "last": part["p"].iloc[-1], "step": np.arange(1, steps + 1), "pred": pred, "sd": sd})

    rows = df.select(F.col(key).alias("series"), F.to_date(order).alias("p"), F.col(value).cast("double").alias("y"), F.explode(F.array(*map(F.lit, models))).alias("model"))
    out = rows.groupBy("series", "model").applyInPandas(one, f"series {kind}, model string, last date, step int, pred double, sd double")
    return out.select("series", "model", F.last_day(F.add_months("last", F.col("step") * months)).alias("p"), "pred", (F.col("pred") - 1.96 * F.col("sd")).alias("lo"), (F.col("pred") + 1.96 * F.col("sd")).alias("hi"))


def series(df: DataFrame, granularity: str) -> DataFrame:
    """Revenue per type and period, gaps interpolated."""
    d = df.where("closing_at is not null").groupBy(F.col("opp_type").alias("s"), period_end("closing_at", granularity).alias("p")).agg(F.sum("revenue").alias("y"))
    return interpolate(d)


for _g in TEST:
    book.on_view(f"F9_rolling_{_g}")(lambda df, g=_g: rolling_origin(series(df, g), test=TEST[g], season=SEASON[g]).select("series", "model", F.date_format("p", "yyyy-MM-dd").alias("p"), *(F.round(c, 3).alias(c) for c in ("y", "pred"))))
    book.on_view(f"F11_future_{_g}")(lambda df, g=_g: recursive(series(df, g), granularity=g).select("series", "model", F.date_format("p", "yyyy-MM-dd").alias("p"), *(F.round(c, 3).alias(c) for c in ("pred", "lo", "hi"))))


for _name, _model in (("F10b_autoregressive", "ar"), ("F10c_seasonal_trend", "trend")):
    book.on_view(_name)(lambda df, m=_model: recursive(series(df, "month"), (m,), horizon=12).select("series", F.date_format("p", "yyyy-MM-dd").alias("p"), F.round("pred", 3).alias("pred")))


@book.on_view("F9_trend_year", "with filled as (select opp_type as s, make_date(year(closing_at)::int, 12, 31) as p, sum(revenue) as y from opp where closing_at is not null group by 1, 2), f as (select s, p, y, row_number() over (partition by s order by p) - 1 as t, count(*) over (partition by s) as n from filled), l as (select *, regr_slope(y, t) over w as a, regr_intercept(y, t) over w as b, lag(y) over (partition by s order by p) as last, count(*) over w as m from f window w as (partition by s order by p rows between unbounded preceding and 1 preceding)) select s as series, strftime(p, '%Y-%m-%d') as p, round(y, 3) as y, round(case when m = 1 then last else a * t + b end, 3) as pred from l where t >= greatest(1, n - 3)")
def trend_year(df: DataFrame) -> DataFrame:
    """The trend model over years, where it is a line: running least squares of every origin."""
    return rolling_origin(series(df, "year"), ("trend",), test=TEST["year"], season=1).select("series", F.date_format("p", "yyyy-MM-dd").alias("p"), F.round("y", 3).alias("y"), F.round("pred", 3).alias("pred"))


@book.on_view("F9_metrics")
def rolling_metrics(df: DataFrame) -> DataFrame:
    """Metrics of the rolling forecasts per model, granularity and series."""
    out = None
    for g in TEST:
        part = forecast_metrics(rolling_origin(series(df, g), test=TEST[g], season=SEASON[g]), ["model", "series"]).withColumn("granularity", F.lit(g))
        out = part if out is None else out.union(part)
    return out.select("granularity", "model", "series", "n", *(F.round(c, 3).alias(c) for c in ("mae", "rmse", "mape")))


@book.on_view("F9_rolling_last", f"with {_I}, l as (select s as series, p, y, lag(y) over (partition by s order by p) as pred, row_number() over (partition by s order by p desc) as r from f) select series, p, round(y, 4) as y, round(pred, 4) as pred from l where r <= 12 and pred is not null")
def rolling_last(df: DataFrame, test: int = 12) -> DataFrame:
    """The scheme with the simplest model, the last known value."""
    w = Window.partitionBy("s").orderBy("p")
    r = interpolate(monthly(df)).select(F.col("s").alias("series"), "p", "y", F.lag("y").over(w).alias("pred"), F.row_number().over(Window.partitionBy("s").orderBy(F.desc("p"))).alias("r"))
    return r.where((F.col("r") <= test) & F.col("pred").isNotNull()).select("series", "p", F.round("y", 4).alias("y"), F.round("pred", 4).alias("pred"))


@book.on_view("F8_fold_metrics", f"""with {_I}, l as (select s, p, y, lag(y) over (partition by s order by p) as pred, row_number() over (partition by s order by p) as i, count(*) over (partition by s) as n from f), k as (select unnest(range(1, 6)) as fold),
  fm as (select s, fold, avg(abs(pred - y)) as mae, sqrt(avg((pred - y) ** 2)) as rmse from l, k where pred is not null and i > n - (6 - fold) * (n // 6) and i <= n - (5 - fold) * (n // 6) group by 1, 2)
  select s, count(*) as folds, round(avg(mae), 3) as mae_mean, round(stddev_samp(mae), 3) as mae_std, round(avg(rmse), 3) as rmse_mean, round(stddev_samp(rmse), 3) as rmse_std from fm group by 1""")
def fold_metrics(df: DataFrame, splits: int = 5) -> DataFrame:
    """Mean and deviation of the metrics over expanding folds."""
    w = Window.partitionBy("s")
    r = interpolate(monthly(df)).select("s", "y", F.lag("y").over(w.orderBy("p")).alias("pred"), F.row_number().over(w.orderBy("p")).alias("i"), F.count("*").over(w).alias("n")).select("*", F.explode(F.sequence(F.lit(1), F.lit(splits))).alias("fold"))
    size = F.floor(F.col("n") / (splits + 1))
    inside = r.where((F.col("i") > F.col("n") - (splits + 1 - F.col("fold")) * size) & (F.col("i") <= F.col("n") - (splits - F.col("fold")) * size) & F.col("pred").isNotNull())
    m = forecast_metrics(inside, ["s", "fold"])
    return m.groupBy("s").agg(F.count("*").alias("folds"), *(F.round(f(c), 3).alias(f"{c}_{t}") for c in ("mae", "rmse") for t, f in (("mean", F.avg), ("std", F.stddev))))


_K = "k as (select opp_type as s, year(closing_at)::int as year, count(distinct month(closing_at))::double as y from opp where closing_at is not null group by 1, 2), c as (select s, count(distinct y) = 1 as flat, arg_max(y, year) as last, max(year) as year from k where year between 1993 and 1997 group by 1)"


@book.on_view("F10a_constant", f"with {_K} select s, (c.year + h)::int as year, last as pred, 0.0::double as error from c, unnest(range(1, 6)) t(h) where flat")
def constant(df: DataFrame, horizon: int = 5) -> DataFrame:
    """A series with one distinct value (months with closings per full year) is not fitted: the forecast repeats it, the error is 0."""
    k = df.where("closing_at is not null").groupBy(F.col("opp_type").alias("s"), F.year("closing_at").alias("year")).agg(F.count_distinct(F.month("closing_at")).cast("double").alias("y")).where(F.col("year").between(1993, 1997))
    c = k.groupBy("s").agg(F.count_distinct("y").alias("values"), F.max_by("y", "year").alias("last"), F.max("year").alias("year")).where("values = 1")
    return c.select("s", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"), "year", "last").select("s", (F.col("year") + F.col("h")).cast("int").alias("year"), F.col("last").alias("pred"), F.lit(0.0).alias("error"))


@book.on_view("F10d_boosted_global")
def boosted_global(df: DataFrame, lags: int = 4) -> DataFrame:
    """One gradient-boosted model over all series: lags, month and the series as features; predictions of each series' last year."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    w = Window.partitionBy("s").orderBy("p")
    r = series(df, "month").select("s", "p", "y", F.month("p").alias("month"), *(F.lag("y", i).over(w).alias(f"lag{i}") for i in range(1, lags + 1)), F.row_number().over(Window.partitionBy("s").orderBy(F.desc("p"))).alias("back")).dropna()
    r = StringIndexer(inputCol="s", outputCol="number", stringOrderType="alphabetAsc").fit(r).transform(r)
    r = VectorAssembler(inputCols=["number", "month", *(f"lag{i}" for i in range(1, lags + 1))], outputCol="v").transform(r)
    model = GBTRegressor(featuresCol="v", labelCol="y", predictionCol="pred", maxIter=20, maxDepth=3, seed=7).fit(r.where(F.col("back") > TEST["month"]))
    return model.transform(r.where(F.col("back") <= TEST["month"])).select(F.col("s").alias("series"), F.date_format("p", "yyyy-MM-dd").alias("p"), F.round("y", 3).alias("y"), F.round("pred", 3).alias("pred"))


@book.on_view("I17_conversion_forecasts")
def conversion_forecasts(df: DataFrame) -> DataFrame:
    """Conversion-rate forecasts from the train months against the test months, with MAE, RMSE and MAPE per model."""
    c = conversion_monthly(df).withColumn("s", F.lit("conversion")).withColumn("p", F.to_date("period_end"))
    test = c.where("split = 'test'")
    ahead = recursive(c.where("split = 'train'").select("s", "p", F.col("conv_rate").alias("y")), ("ar", "trend"), horizon=24)
    both = ahead.join(test.select("p", F.col("conv_rate").alias("y")), "p")
    return forecast_metrics(both, ["model"]).select("model", "n", *(F.round(x, 5).alias(x) for x in ("mae", "rmse", "mape")))

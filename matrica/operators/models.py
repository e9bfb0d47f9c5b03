"""Repeated stratified cross-validation of linear models, one repeat of a task per Spark group."""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Generator, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrica.session import cut_lineage

MODELS = ("logreg_l1", "linear_svm")
#: Samples of a task up to which one Spark group fits its folds, and values (samples by features) up to which it does whatever the samples.
MOST_SAMPLES, MOST_VALUES = 20_000, 4_000_000


def fold_table(samples: DataFrame, *, repeats: int = 10, folds: int = 5, seed: int = 42, by: Sequence[str] = ("task_name", "positive")) -> DataFrame:
    """sample, task and class side with (repeat, fold): stratified folds by a hash order, the same on every run."""
    rows = samples.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    order = Window.partitionBy(*by, "repeat").orderBy(F.xxhash64("sample", "repeat", F.lit(seed)), "sample")
    return rows.withColumn("fold", (F.row_number().over(order) - 1) % folds)


def _newton_step(g: np.ndarray, h: np.ndarray, w: np.ndarray, sweeps: int = 500) -> np.ndarray:
    """The step d that minimises g d + d h d / 2 + |w + d|_1: coordinates find which weights are zero and the signs of
    the others, for which the step is then solved and taken if it is the optimum."""
    d, hd, size = np.zeros(len(w)), np.zeros(len(w)), h.diagonal()
    for k in range(sweeps):
        if k % 5 == 4:
            sign, step = np.sign(w + d), -w
            own = sign != 0
            step[own] = np.linalg.solve(h[np.ix_(own, own)], h[np.ix_(own, ~own)] @ w[~own] - g[own] - sign[own])
            if (np.sign(w + step)[own] == sign[own]).all() and (np.abs(g + h @ step)[~own] <= 1).all():
                return step
        most = 0.0
        for j in range(len(w)):
            at = w[j] + d[j] - (g[j] + hd[j]) / size[j]
            move = np.sign(at) * max(abs(at) - 1 / size[j], 0.0) - w[j] - d[j]
            if move:
                d[j] += move
                hd += h[j] * move
                most = max(most, abs(move))
        if most <= 1e-12 * (1 + np.abs(w).max()):
            break
    return d


def _weights(y: np.ndarray, n: int, p: int) -> np.ndarray:
    """Weights that balance the classes of n rows, p of them positive."""
    return np.where(y > 0, n / (2 * max(1, p)), n / (2 * max(1, n - p)))


def _sums(a: np.ndarray, weight: np.ndarray, w: np.ndarray, model: str) -> tuple[float, Callable[[], tuple[np.ndarray, np.ndarray]]]:
    """The rows' part of the loss at weights w, and what gives its gradient and second derivatives. a: rows with a one,
    times the sign of their class."""
    m = a @ w
    if model == "logreg_l1":

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(np.clip(m, -500, 500)))
            return -(a.T @ (weight * p)), a.T @ (a * (weight * p * (1 - p))[:, None])

        return weight @ np.logaddexp(0, -m), slopes

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        near = m < 1
        part, own = a[near], weight[near]
        return -2 * (part.T @ (own * (1 - m[near]))), 2 * (part.T @ (part * own[:, None]))

    return weight @ np.maximum(0, 1 - m) ** 2, slopes


def _course(model: str, width: int, steps: int = 100) -> Generator[np.ndarray, tuple, np.ndarray]:
    """Newton steps down to the optimum of the penalised loss: yields weights, is sent _sums there, returns the last ones.

    The rows come in by their sums alone, so fits over one group and over distributed rows take the same course.
    """
    logistic, w = model == "logreg_l1", np.zeros(width)
    penalty = lambda w: np.abs(w).sum() if logistic else w @ w / 2
    now, slopes = yield w
    now += penalty(w)
    for _ in range(steps):
        g, h = slopes()
        if logistic:
            h[np.diag_indices_from(h)] += 1e-9 * max(h.trace(), 1e-3)
            d = _newton_step(g, h, w)
            fall = g @ d + np.abs(w + d).sum() - np.abs(w).sum()
        else:
            g = g + w
            d = -np.linalg.solve(h + np.eye(width), g)
            fall = g @ d
        t = 1.0
        while True:
            new, slopes = yield w + t * d
            new += penalty(w + t * d)
            if new <= now + 1e-4 * t * fall or t <= 1e-10:
                break
            t /= 2
        if new >= now:
            break
        w = w + t * d
        done, now = now - new <= 1e-14 * now and np.abs(t * d).max() <= 1e-9 * (1 + np.abs(w).max()), new
        if done:
            break
    return w


def _signed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.c_[x, np.ones(len(x))] * np.where(y > 0, 1.0, -1.0)[:, None]


def _fit(x: np.ndarray, y: np.ndarray, model: str) -> tuple[np.ndarray, float]:
    """Balanced L1 logistic regression or squared-hinge SVM with C = 1, by Newton steps down to the optimum."""
    a, weight, course = _signed(x, y), _weights(y, len(y), int((y > 0).sum())), _course(model, x.shape[1] + 1)
    at = next(course)
    while True:
        try:
            at = course.send(_sums(a, weight, at, model))
        except StopIteration as end:
            return end.value[:-1], float(end.value[-1])


def _moments(x: np.ndarray) -> np.ndarray:
    """Of each column count, mean, sum of squares about it, least and most."""
    if not len(x):
        return np.r_[np.zeros((3, x.shape[1])), np.full((1, x.shape[1]), np.inf), np.full((1, x.shape[1]), -np.inf)]
    mean = x.mean(0)
    return np.array([np.full(x.shape[1], float(len(x))), mean, ((x - mean) ** 2).sum(0), x.min(0), x.max(0)])


def _united(parts: Sequence[np.ndarray]) -> np.ndarray:
    """The moments of the rows of all parts."""
    m = np.array(parts)
    n = m[:, 0].sum(0)
    mean = (m[:, 0] * m[:, 1]).sum(0) / np.maximum(n, 1)
    return np.array([n, mean, (m[:, 2] + m[:, 0] * (m[:, 1] - mean) ** 2).sum(0), m[:, 3].min(0), m[:, 4].max(0)])


def _selection(p: np.ndarray, n: np.ndarray, k_best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, standard deviation, places of the k best columns by F statistic) by the moments of both classes.

    Constant columns are told by their least and most value, and scores are compared to ten digits, so that nothing hangs on the order of sums.
    """
    both = _united([p, n])
    sd = np.where(both[4] > both[3], np.sqrt(both[2] / both[0]), 0)
    within = np.where((p[4] > p[3]) | (n[4] > n[3]), p[2] + n[2], 0)
    between = p[0] * (p[1] - both[1]) ** 2 + n[0] * (n[1] - both[1]) ** 2
    score = np.where(within > 0, between / np.where(within > 0, within, 1), np.where(sd > 0, np.inf, 0.0))
    part, power = np.frexp(score)
    score = np.ldexp(np.round(part, 10), power)
    return both[1], np.where(sd > 0, sd, 1), np.sort(np.argsort(-score, kind="stable")[: min(max(2, k_best), len(sd))])


def _standard(x: np.ndarray, mean: np.ndarray, sd: np.ndarray, best: np.ndarray) -> np.ndarray:
    return (x[:, best] - mean[best]) / sd[best]


def _auc(score: np.ndarray, y: np.ndarray) -> float:
    ranks = pd.Series(score).rank().to_numpy()
    p, n = int((y > 0).sum()), int((y <= 0).sum())
    return float((ranks[y > 0].sum() - p * (p + 1) / 2) / (p * n)) if p and n else float("nan")


def dense_vectors(cells: DataFrame, features: Sequence[str], keys: Sequence[str], value: str = "intensity") -> DataFrame:
    """keys and x: the values of each row of keys in the order of ``features``, missing ones 0.

    Every row meets the list of features once, so no wide table is planned whatever their number.
    """
    names = F.array(*map(F.lit, features))
    grid = cells.select(*keys).distinct().select("*", F.posexplode(names).alias("j", "feature"))
    held = cells.where(F.col("feature").isin(*features) if len(features) <= 100 else F.lit(True)).groupBy(*keys, "feature").agg(F.first(value).alias("v"))
    full = grid.join(held, [*keys, "feature"], "left").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("j", F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v")))).alias("e"))
    return full.select(*keys, F.transform("e", lambda x: x["v"]).alias("x"))


_KEYS = "task_name string, feature_space string, model_name string, repeat int, fold int"
_METRICS = ("auroc", "balanced_accuracy", "f1", "precision", "recall")
_FITTED = f"{_KEYS}, {', '.join(f'{m} double' for m in _METRICS)}, n_train bigint, n_test bigint, chosen array<string>, coefficient array<double>"


def _rates_of(tp: int, fp: int, fn: int, tn: int) -> tuple[float, float, float, float]:
    """Balanced accuracy, F1, precision and recall; a rate without cases is 0."""
    rate = lambda a, b: float(a / b) if b else 0.0
    return (rate(tp, tp + fn) + rate(tn, tn + fp)) / 2, rate(2 * tp, 2 * tp + fp + fn), rate(tp, tp + fp), rate(tp, tp + fn)


def cross_validate(cells: DataFrame, folds: DataFrame, features: Sequence[str], *, space: str, models: Sequence[str] = MODELS, k_best: int = 20, most_samples: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics per fold, coefficients per fold of the selected features) of all tasks, models, repeats and folds.

    cells: task_name, sample, positive, feature, intensity; folds: see fold_table. Every fold is standardised, keeps the
    k best features by F statistic and fits the model with balanced classes. A task of up to ``most_samples`` samples (by
    default MOST_SAMPLES, or more while they hold up to MOST_VALUES values) has many small fits, those of a repeat in one
    Spark group; a larger one has the same fits, taking the same sums over its distributed rows, so the results do not
    depend on where they are made. Missing values are 0; a fold whose training part lacks a class has no row.
    """
    spark, names = cells.sparkSession, list(features)
    wide = cut_lineage(dense_vectors(cells, names, ["task_name", "sample", "positive"]))
    sizes = {r["task_name"]: r["n"] for r in wide.groupBy("task_name").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per task
    most = most_samples if most_samples is not None else max(MOST_SAMPLES, MOST_VALUES // max(1, len(names)))
    large = [t for t, n in sizes.items() if n > most]
    held = folds.select("task_name", "sample", "repeat", F.col("fold").alias("own"))
    small = wide.where(~F.col("task_name").isin(*large)) if large else wide
    data = small.join(held, ["task_name", "sample"])
    columns = [c.split()[0] for c in _FITTED.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        task, repeat = key
        x, y, own, out = np.stack(pdf["x"].to_numpy()), pdf["positive"].to_numpy(dtype=bool), pdf["own"].to_numpy(), []
        for fold in np.unique(own):
            test = own == fold
            if not (~test & y).any() or not (~test & ~y).any():
                continue
            mean, sd, best = _selection(_moments(x[~test & y]), _moments(x[~test & ~y]), k_best)
            z = _standard(x, mean, sd, best)
            for model in models:
                w, bias = _fit(z[~test], y[~test].astype(float), model)
                value = (z[test] * w).sum(1) + bias  # equal rows have equal values
                truth, guess = y[test], value > 0
                rates = _rates_of((truth & guess).sum(), (~truth & guess).sum(), (truth & ~guess).sum(), (~truth & ~guess).sum())
                out.append((task, space, model, repeat, int(fold), _auc(value, truth.astype(float)), *rates, int((~test).sum()), int(test.sum()), [names[i] for i in best], w.tolist()))
        return pd.DataFrame(out, columns=columns)

    fitted = data.groupBy("task_name", "repeat").applyInPandas(run, _FITTED)
    if large:
        fitted = fitted.unionByName(_validate_large(wide.where(F.col("task_name").isin(*large)), folds, names, space, models, k_best))
    fitted = cut_lineage(fitted)  # metrics and coefficients are of the same fits
    pairs = fitted.select("task_name", "feature_space", "model_name", "repeat", "fold", F.explode(F.arrays_zip("chosen", "coefficient")).alias("c"))
    return fitted.drop("chosen", "coefficient"), pairs.select("task_name", "feature_space", "model_name", "repeat", "fold", F.col("c.chosen").alias("feature"), "c.coefficient")


def _validate_large(wide: DataFrame, folds: DataFrame, names: list[str], space: str, models: Sequence[str], k_best: int) -> DataFrame:
    """One row per fold and model, as of a group, of tasks whose rows stay distributed.

    All fits of a task go side by side, so a pass over its rows gives the sums that each of them asks for next. The
    driver holds the weights and sums of the fits, whose number does not grow with the rows.
    """
    own = folds.groupBy("task_name", "sample").agg(F.sort_array(F.collect_list(F.struct("repeat", "fold"))).alias("own"))
    data = wide.select("task_name", "sample", "positive", "x").join(own, ["task_name", "sample"])
    data = cut_lineage(data.select("task_name", "positive", "x", F.col("own.repeat").alias("repeats"), F.col("own.fold").alias("folds")))
    parts = [_validate_task(data.where(F.col("task_name") == t["task_name"]), t["task_name"], names, space, models, k_best) for t in data.select("task_name").distinct().orderBy("task_name").collect()]
    return reduce(DataFrame.unionByName, parts)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]]:
    """x, y and the fold of each row by repeat (-1 where it has none) of every batch."""
    for pdf in batches:
        if len(pdf):
            places = [dict(zip(r, f)) for r, f in zip(pdf["repeats"], pdf["folds"])]
            yield np.stack(pdf["x"].to_numpy()), pdf["positive"].to_numpy(dtype=bool), {int(r): np.array([p.get(r, -1) for p in places]) for r in set().union(*places)}


def _passed(data: DataFrame, each: Callable[[np.ndarray, np.ndarray, dict[int, np.ndarray]], dict], add: Callable) -> dict:
    """What ``each`` gives of every block, by key, put together by ``add`` in each task and then by key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for block in _blocks(batches):
            for key, value in each(*block).items():
                held[key] = add(held[key], value) if key in held else value
        yield pd.DataFrame({"key": [json.dumps(k) for k in held], "part": [pickle.dumps(v) for v in held.values()]})

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": pdf["key"][:1], "part": [pickle.dumps(reduce(add, map(pickle.loads, pdf["part"])))]})

    parts = data.drop("task_name").mapInPandas(run, "key string, part binary").groupBy("key").applyInPandas(merged, "key string, part binary")
    return {tuple(json.loads(r["key"])): pickle.loads(r["part"]) for r in parts.collect()}  # one row per key


def _validate_task(data: DataFrame, task: str, names: list[str], space: str, models: Sequence[str], k_best: int) -> DataFrame:
    def cells(x: np.ndarray, y: np.ndarray, own: dict[int, np.ndarray]) -> dict:
        return {(r, int(f), c): _moments(x[(at == f) & (y == c)]) for r, at in own.items() for f in np.unique(at[at >= 0]) for c in (True, False)}

    held = _passed(data, cells, lambda a, b: _united([a, b]))
    plans, courses, asked, fitted = {}, {}, {}, {}
    for r, f in sorted({key[:2] for key in held}):
        train = {c: [m for (q, g, d), m in held.items() if (q, d) == (r, c) and g != f] for c in (True, False)}
        sides = [_united(train[c]) if train[c] else None for c in (True, False)]
        if any(m is None or not m[0].any() for m in sides):
            continue
        n, p = int(sides[0][0, 0] + sides[1][0, 0]), int(sides[0][0, 0])
        plans[r, f] = (*_selection(*sides, k_best), n, p)
        for model in models:
            courses[r, f, model] = _course(model, len(plans[r, f][2]) + 1)
            asked[r, f, model] = next(courses[r, f, model])
    while asked:
        now = dict(asked)

        def sums(x: np.ndarray, y: np.ndarray, own: dict[int, np.ndarray]) -> dict:
            out = {}
            for (r, f), (mean, sd, best, n, p) in plans.items():
                wanted = [m for m in models if (r, f, m) in now]  # noqa: B023  used up in this round
                train = (own[r] != f) & (own[r] >= 0) if wanted and r in own else np.zeros(len(x), dtype=bool)
                if train.any():
                    a, weight = _signed(_standard(x[train], mean, sd, best), y[train]), _weights(y[train], n, p)
                    for m in wanted:
                        loss, slopes = _sums(a, weight, now[r, f, m], m)  # noqa: B023
                        out[r, f, m] = (loss, *slopes())
            return out

        for key, (loss, g, h) in _passed(data, sums, lambda a, b: tuple(i + j for i, j in zip(a, b))).items():
            try:
                asked[key] = courses[key].send((loss, lambda g=g, h=h: (g, h)))
            except StopIteration as end:
                fitted[key] = end.value
                del asked[key]

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x, y, own in _blocks(batches):
            for (r, f, m), w in fitted.items():
                test = own[r] == f if r in own else np.zeros(len(x), dtype=bool)
                if test.any():
                    value = (_standard(x[test], *plans[r, f][:3]) * w[:-1]).sum(1) + w[-1]
                    yield pd.DataFrame({"model_name": m, "repeat": r, "fold": f, "value": value + 0.0, "positive": y[test]})

    keys = ["model_name", "repeat", "fold"]
    scored = data.drop("task_name").mapInPandas(values, "model_name string, repeat int, fold int, value double, positive boolean")
    tied = scored.groupBy(*keys, "value").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    below = F.sum("n").over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    over = F.col("value") > 0
    rates = tied.withColumn("below", below).groupBy(*keys).agg(
        F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("wins"), *[F.sum(F.when(c, F.col(s)).otherwise(0)).alias(name) for name, c, s in (("tp", over, "p"), ("fp", over, "n"), ("fn", ~over, "p"), ("tn", ~over, "n"))]
    )
    out = []
    for r in rates.collect():  # one row per fit
        key, (tp, fp, fn, tn) = (r["repeat"], r["fold"], r["model_name"]), (r[c] for c in ("tp", "fp", "fn", "tn"))
        auc = float(r["wins"] / ((tp + fn) * (fp + tn))) if tp + fn and fp + tn else float("nan")
        best, n = plans[key[:2]][2:4]
        out.append((task, space, key[2], *key[:2], auc, *_rates_of(tp, fp, fn, tn), n, tp + fp + fn + tn, [names[i] for i in best], fitted[key][:-1].tolist()))
    return data.sparkSession.createDataFrame(out, _FITTED)


def benchmark_summary(metrics: DataFrame) -> DataFrame:
    """Means and standard deviations over the folds."""
    means = [F.avg(m).alias(f"mean_{m}") for m in _METRICS]
    return metrics.groupBy("task_name", "feature_space", "model_name").agg(
        *means, F.stddev_samp("auroc").alias("std_auroc"), F.stddev_samp("balanced_accuracy").alias("std_balanced_accuracy"), F.count_distinct("repeat", "fold").alias("n_folds")
    )


def benchmark_spaces(cells: DataFrame, folds: DataFrame, spaces: dict[str, Sequence[str]], **how: object) -> tuple[DataFrame, DataFrame]:
    """cross_validate over several feature spaces (name to features), put together; spaces without features are left out.

    Spaces of the same features have the same fits, which are made once.
    """
    same: dict[tuple[str, ...], list[str]] = {}
    for name, features in spaces.items():
        if len(features):
            same.setdefault(tuple(features), []).append(name)
    parts = [cross_validate(cells, folds, features, space=names[0], **how) for features, names in same.items()]
    own = lambda i: [p[i].withColumn("feature_space", F.lit(name)) if name != names[0] else p[i] for p, names in zip(parts, same.values()) for name in names]
    return reduce(DataFrame.unionByName, own(0)), reduce(DataFrame.unionByName, own(1))

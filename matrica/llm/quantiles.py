"""Mergeable percentile sketches with multiplicative rank error at the tails (relative compactors)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrica.session import cut_lineage

#: Section size of the compactors: larger is more exact and larger in memory.
SECTION = 100
#: Sketches that one merge task takes in for a group at a time.
FAN_IN = 32

#: Sketches that a task holds before it hands them on.
MOST_HELD = 20_000

SKETCH = "n bigint, high array<binary>, high_states array<bigint>, low array<binary>, low_states array<bigint>"


def capacity(n: int, section: int = SECTION) -> int:
    """Values that a level may hold when the sketch has seen n."""
    return 2 * section * max(1, math.ceil(math.log2(max(2.0, n / section))))


def relative_error(n: int, section: int = SECTION) -> float:
    """Three standard deviations of the rank error, as a share of the rank counted from the protected tail.

    A compaction of level h takes two sections of values below the protected ones on average and moves a rank by
    2**h, up or down, if the rank splits a pair, which half of them do not; so the variance at tail rank R is about
    R**2 / (section * capacity). Sketches of n <= capacity are exact.
    """
    full = capacity(n, section)
    return 0.0 if n <= full else 3 / math.sqrt(section * full)


class TailSketch:
    """Compactors that keep the largest values and thin out the others, level h holding values of weight 2**h."""

    def __init__(self, section: int = SECTION, levels: list | None = None, states: list | None = None, n: int = 0) -> None:
        self.section, self.n = section, n
        self.levels = levels or [np.empty(0)]
        self.states = states or [0] * len(self.levels)

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self.levels[0] = np.concatenate([self.levels[0], values])
        self._compact()

    def merge(self, other: TailSketch) -> None:
        self.n += other.n
        for h, (values, state) in enumerate(zip(other.levels, other.states)):
            if h == len(self.levels):
                self.levels.append(values)
                self.states.append(state)
            else:
                self.levels[h] = np.concatenate([self.levels[h], values])
                self.states[h] |= state
        self._compact()

    def _compact(self) -> None:
        full, h = capacity(self.n, self.section), 0
        while h < len(self.levels):
            values = self.levels[h]
            if len(values) > full:
                values = np.sort(values)
                state = self.states[h]
                sections = ((state + 1) & -(state + 1)).bit_length()  # trailing ones of the state, plus one
                keep = max(full // 2, full - sections * self.section)
                many = (len(values) - keep) // 2 * 2
                coin = ((state + 1) * 2654435761 ^ (h + 1) * 2246822519 ^ self.n * 3266489917) >> 13 & 1
                if h + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                    self.states.append(0)
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], values[coin:many:2]])
                self.levels[h], self.states[h] = values[many:], state + 1
            h += 1

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        """Values in ascending order and the estimated number of values up to each."""
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(v), 1 << h, dtype=np.int64) for h, v in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weights[order])


class Sketch:
    """One TailSketch for the high tail and, over negated values, one for the low tail."""

    def __init__(self, high: TailSketch, low: TailSketch) -> None:
        self.high, self.low = high, low

    @classmethod
    def empty(cls, section: int) -> Sketch:
        return cls(TailSketch(section), TailSketch(section))

    @classmethod
    def read(cls, row: pd.Series | object, section: int) -> Sketch:
        part = lambda levels, states: TailSketch(section, [np.frombuffer(b) for b in levels], [int(s) for s in states], int(row.n))
        return cls(part(row.high, row.high_states), part(row.low, row.low_states))

    def add(self, values: np.ndarray) -> None:
        self.high.add(values)
        self.low.add(-values)

    def merge(self, other: Sketch) -> None:
        self.high.merge(other.high)
        self.low.merge(other.low)

    def row(self) -> tuple:
        return self.high.n, [v.tobytes() for v in self.high.levels], self.high.states, [v.tobytes() for v in self.low.levels], self.low.states

    def quantiles(self, probabilities: Sequence[float], section: int) -> list[tuple[float, float]]:
        """(estimate, stated rank error as a share of n) of each probability, from the sketch of the nearer tail."""
        n = self.high.n
        up, up_rank = self.high.weighted()
        down, down_rank = self.low.weighted()
        error, out = relative_error(n, section), []
        for p in probabilities:
            rank = min(max(1, math.ceil(p * n)), n)
            if p >= 0.5:  # rank from above: the estimated number of values up to it is n less those beyond it
                value = up[min(np.searchsorted(n - up_rank[-1] + up_rank, rank), len(up) - 1)]
                out.append((float(value), error * (n - rank + 1) / n))
            else:
                beyond = n - rank + 1  # the value of this rank among the negated ones
                value = -down[min(np.searchsorted(n - down_rank[-1] + down_rank, beyond), len(down) - 1)]
                out.append((float(value), error * rank / n))
        return out


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names)


def build_sketches(df: DataFrame, keys: Sequence[str], value: str, *, section: int = SECTION) -> DataFrame:
    """Sketches of each group in each input partition, with the partition's number in ``part``: keys, part and SKETCH.

    A partition of more than MOST_HELD groups may give a group several. Only finite values count. NULL keys form groups of their own; groups without finite values have no sketch.
    """
    keys = list(keys)
    x = F.col(value).cast("double")
    rows = df.select(*keys, x.alias("v")).where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))).withColumn("part", F.spark_partition_id())
    names = [*keys, "part", "n", "high", "high_states", "low", "low_states"]

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Sketch] = {}
        pending: dict[tuple, list[np.ndarray]] = {}
        size = part = 0
        for pdf in batches:
            part = pdf["part"].iloc[0] if len(pdf) else part
            values = pdf["v"].to_numpy()
            for key, at in (pdf.groupby(keys, dropna=False, sort=False).indices.items() if keys else [((), slice(None))]):
                key = tuple(None if k is None or k != k else k for k in (key if isinstance(key, tuple) else (key,)))
                pending.setdefault(key, []).append(values[at])
            size += len(pdf)
            if size > 200_000:
                _settle(held, pending, section)
                size = 0
                if len(held) > MOST_HELD:
                    yield from handed_on(held, part)
                    held.clear()
        _settle(held, pending, section)
        yield from handed_on(held, part)

    def handed_on(held: dict[tuple, Sketch], part: int) -> Iterator[pd.DataFrame]:
        items = list(held.items())
        for i in range(0, len(items), 2000):
            yield _frame([(*key, part, *s.row()) for key, s in items[i : i + 2000]], names)

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(sketch, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + (", " if keys else "") + f"part int, {SKETCH}")


def _settle(held: dict[tuple, Sketch], pending: dict[tuple, list[np.ndarray]], section: int) -> None:
    for key, arrays in pending.items():
        held.setdefault(key, Sketch.empty(section)).add(np.concatenate(arrays))
    pending.clear()


def merge_sketches(sketches: DataFrame, keys: Sequence[str], parts: int, *, section: int = SECTION) -> DataFrame:
    """Merge the sketches of each group: keys, part (0) and SKETCH.

    ``parts`` bounds the numbers in ``part``. A tree of rounds takes at most FAN_IN sketches of a group into one,
    so no task receives all sketches of a hot group.
    """
    keys = list(keys)
    names = [*keys, "part", "n", "high", "high_states", "low", "low_states"]
    schema = sketches.select(*names).schema

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, now, done = None, None, []
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                key = tuple(None if k is None or k != k else k for k in row[: len(keys) + 1])
                one = Sketch.read(row, section)
                if key == last:
                    now.merge(one)
                else:
                    if now is not None:
                        done.append((*last, *now.row()))
                    last, now = key, one
                if len(done) >= 2000:
                    yield _frame(done, names)
                    done = []
        if now is not None:
            done.append((*last, *now.row()))
        if done:
            yield _frame(done, names)

    out, first = sketches.select(*names), True
    while parts > 1 or first:
        first = False
        parts = math.ceil(parts / FAN_IN)
        out = out.withColumn("part", (F.col("part") / FAN_IN).cast("int"))
        out = out.repartition(*keys, "part").sortWithinPartitions(*keys, "part").mapInPandas(merge, schema)
    return out


def sketch_quantiles(sketches: DataFrame, keys: Sequence[str], probabilities: Sequence[float], *, section: int = SECTION) -> DataFrame:
    """keys, q, value, rank_error, n: estimates from merged sketches.

    value estimates the smallest value that at least a share q of the group does not exceed. rank_error is the
    stated bound (three standard deviations) on the estimate's rank error, as a share of n; 0 means exact.
    """
    keys = list(keys)
    kinds = dict(sketches.dtypes)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                answers = Sketch.read(row, section).quantiles(probabilities, section)
                rows += [(*row[: len(keys)], p, v, e, row.n) for p, (v, e) in zip(probabilities, answers)]
            yield _frame(rows, [*keys, "q", "value", "rank_error", "n"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + (", " if keys else "") + "q double, value double, rank_error double, n bigint"
    return sketches.select(*keys, "n", "high", "high_states", "low", "low_states").mapInPandas(ask, schema)


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], *, section: int = SECTION) -> DataFrame:
    """Percentiles per group in one go: sketches by partition, merged in a tree, then asked."""
    return sketch_quantiles(merged_sketches(df, keys, value, section=section), keys, probabilities, section=section)


def merged_sketches(df: DataFrame, keys: Sequence[str], value: str, *, section: int = SECTION) -> DataFrame:
    """One sketch per group. The partitions' sketches are written, which runs df once and tells how many there are."""
    parts = cut_lineage(build_sketches(df, keys, value, section=section))
    most = parts.agg(F.max("part")).first()[0]
    return merge_sketches(parts, keys, 1 if most is None else most + 1, section=section)


def rank_check(df: DataFrame, estimates: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, q, n and within: whether each estimate's true rank range meets its stated error, from one exact pass."""
    keys = list(keys)
    x = F.col(value).cast("double")
    rows = df.select(*[F.col(k).alias(f"_{k}") for k in keys], x.alias("x")).where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    # One array of estimates per group: rows are counted against it without being repeated.
    asked = estimates.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("q", "value", "rank_error", "n"))).alias("asked"))
    width = F.transform("asked", lambda a: F.struct((F.col("x") < a["value"]).cast("bigint").alias("below"), (F.col("x") <= a["value"]).cast("bigint").alias("upto")))
    counted = rows.join(asked, on).select(*keys, F.posexplode(F.arrays_zip("asked", width.alias("c"))).alias("i", "a"))
    sums = counted.groupBy(*keys, "i").agg(F.first("a.asked").alias("asked"), F.sum("a.c.below").alias("below"), F.sum("a.c.upto").alias("upto"))
    rank, slack = F.ceil(F.col("asked.q") * F.col("asked.n")), F.col("asked.rank_error") * F.col("asked.n") + 1
    return sums.select(*keys, F.col("asked.q").alias("q"), F.col("asked.n").alias("n"), ((F.col("upto") >= rank - slack) & (F.col("below") + 1 <= rank + slack)).alias("within"))

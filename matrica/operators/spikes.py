"""Implausible readings of ordered series: spikes in phase space, stuck values and impossible values."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matrica.functions.keys import BROADCAST_ROWS, HOT_ROWS, hot_keys, join_counted, join_null_safe
from matrica.functions.robust import MAD_TO_SD, with_median_mad
from matrica.session import cut_lineage, release

#: Rows of a series that one task orders; longer series are cut into pieces that are joined at their ends.
PIECE = 65_536
#: Spikes that a series without faults may show on average; its limit grows with its length accordingly.
FALSE_SPIKES = 0.01


def cut_pieces(rows: DataFrame, order: str, size: int = PIECE, series: str = "series") -> DataFrame:
    """rows with ``piece``: consecutive stretches of about ``size`` rows along (series, order), however sparse the order.

    Spark's range partitions are the pieces; equal (series, order) share one. Written, so the numbers stay.
    """
    parts = max(1, -(-rows.count() // size))
    return cut_lineage(rows.repartitionByRange(parts, series, order).withColumn("piece", F.spark_partition_id()))


def neighbours_along(runs: DataFrame, value: Column) -> DataFrame:
    """Add before and after (structs of v): the neighbours' values along the series, across piece borders."""
    piece = Window.partitionBy("series", "piece").orderBy("pos")
    whole = Window.partitionBy("series").orderBy("piece")
    held = runs.withColumn("__v", F.struct(value.alias("v")))
    ends = held.groupBy("series", "piece").agg(F.min_by("__v", "pos").alias("first"), F.max_by("__v", "pos").alias("last"))
    ends = ends.select("series", "piece", F.lag("last").over(whole).alias("prev_last"), F.lead("first").over(whole).alias("next_first"))
    local = held.withColumn("before", F.lag("__v").over(piece)).withColumn("after", F.lead("__v").over(piece))
    joined = join_null_safe(local, ends, ["series", "piece"])
    return joined.withColumn("before", F.coalesce("before", "prev_last")).withColumn("after", F.coalesce("after", "next_first")).drop("__v", "prev_last", "next_first")


def stuck_runs(runs: DataFrame, min_length: int = 5) -> DataFrame:
    """Positions (series, pos) in a row of at least ``min_length`` equal values; a null value ends the row.

    Equal neighbours get the position where their row of runs began. Within a piece that is a window; a row that
    crosses piece borders is followed over the pieces' first and last values, then lengths are summed with partial
    counts, so neither a long series nor a long row meets one task.
    """
    piece = Window.partitionBy("series", "piece").orderBy("pos")
    start = F.lag(F.struct("value")).over(piece)
    begins = start.isNull() | F.col("value").isNull() | ~F.col("value").eqNullSafe(start["value"])
    local = runs.select("series", "piece", "pos", "value").withColumn("begin", F.when(begins, F.col("pos")))
    local = local.withColumn("seg", F.last("begin", ignorenulls=True).over(piece.rowsBetween(Window.unboundedPreceding, 0)))
    ends = local.groupBy("series", "piece").agg(
        F.min_by(F.struct("value"), "pos").alias("first"), F.max_by(F.struct("value"), "pos").alias("last"), F.min("seg").alias("first_seg"), F.max("seg").alias("last_seg")
    )
    whole = Window.partitionBy("series").orderBy("piece")
    before = F.lag("last").over(whole)
    ends = ends.withColumn("goes_on", F.coalesce(F.col("first.value").eqNullSafe(before["value"]) & F.col("first.value").isNotNull() & before.isNotNull(), F.lit(False)))
    ends = ends.withColumn("own", F.when(~(F.col("goes_on") & (F.col("first_seg") == F.col("last_seg"))), F.col("last_seg")))
    held = F.last("own", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("joins", F.when(F.col("goes_on"), held)).select("series", "piece", "first_seg", "joins")
    local = join_null_safe(local, ends, ["series", "piece"]).withColumn("seg", F.when((F.col("seg") == F.col("first_seg")) & F.col("joins").isNotNull(), F.col("joins")).otherwise(F.col("seg")))
    local = local.where(F.col("value").isNotNull()).select("series", "pos", "seg")
    long = local.groupBy("series", "seg").agg(F.count(F.lit(1)).alias("len")).where(F.col("len") >= min_length).select("series", "seg")
    return join_counted(local, long, ["series", "seg"], "left_semi").select("series", "pos")


def phase_space_spikes(rows: DataFrame, *, limit: float = 6.0, max_iterations: int | None = None) -> DataFrame:
    """The rows (series, pos, u, iteration) that lie outside a robust ellipsoid over value and differences.

    rows: series, piece, pos, u, the reading in robust standard deviations of its own group. Rows with one (series,
    pos) are one run; the differences d1 = (after - before) / 2 and d2 = after - 2 mean + before are those of the
    runs' means, while each row is held against the ellipsoid with its own u. Its half axes are c robust standard
    deviations, where c = min(limit, sqrt(2 ln(n / FALSE_SPIKES))) for a series of n runs: 1 for u, and for the
    differences 1.4826 median absolute differences of the series (percentile_approx, accuracy 10 000). It is turned
    in the plane of u and d2 by their robust correlation, from the spreads of their sum and difference, so its
    shadow on each axis stays c: a row with abs(u) > c is outside whatever its neighbours are. A difference that
    does not exist, or has no spread, adds nothing. Rows found are taken out and the differences formed anew, until
    none is found (or ``max_iterations`` is reached). A series without a find in one round has none in the next.
    """
    rows = left = rows.where(F.col("u").isNotNull()).groupBy("series", "piece", "pos", "u").agg(F.count(F.lit(1)).alias("w"))
    middle = lambda x: F.percentile_approx(F.abs(x), 0.5, 10_000)
    found, n_found = None, 0
    for iteration in count(1) if max_iterations is None else range(1, max_iterations + 1):
        runs = left.groupBy("series", "piece", "pos").agg((F.sum(F.col("u") * F.col("w")) / F.sum("w")).alias("m"))
        near = neighbours_along(runs, F.col("m")).select("series", "piece", "pos", "m", ((F.col("after.v") - F.col("before.v")) / 2).alias("d1"), (F.col("after.v") - 2 * F.col("m") + F.col("before.v")).alias("d2"))
        near = cut_lineage(near)
        # One row per series; only series longer than a piece come here from flag_readings, so they are few.
        spread = near.groupBy("series").agg(F.count(F.lit(1)).alias("n"), (MAD_TO_SD * middle("d1")).alias("s1"), (MAD_TO_SD * middle("d2")).alias("s2"))
        spread = cut_lineage(spread)
        z2 = F.try_divide(F.col("d2"), F.col("s2"))
        tilt = join_null_safe(near, spread, ["series"]).groupBy("series").agg(middle(F.col("m") + z2).alias("a"), middle(F.col("m") - z2).alias("b"))
        a, b = F.col("a") * F.col("a"), F.col("b") * F.col("b")
        tilt = tilt.select("series", F.coalesce(F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.try_divide(a - b, a + b))), F.lit(0.0)).alias("rho"))
        shape = cut_lineage(join_null_safe(spread, tilt, ["series"]))
        held = join_null_safe(left, near.select("series", "piece", "pos", "d1", "d2"), ["series", "piece", "pos"])
        held = join_null_safe(held, shape, ["series"])
        z1 = F.coalesce(F.try_divide(F.col("d1"), F.col("s1")), F.lit(0.0))
        plane = (F.pow("u", 2) - 2 * F.col("rho") * F.col("u") * z2 + F.pow(z2, 2)) / (1 - F.pow("rho", 2))
        axis = F.least(F.lit(limit), F.sqrt(2 * F.log(F.col("n") / FALSE_SPIKES)))
        outside = F.coalesce(plane, F.pow("u", 2)) + F.pow(z1, 2) > F.pow(axis, 2)
        now = held.where(outside).select("series", "pos", "u", F.lit(iteration).alias("iteration"))
        now = cut_lineage(now)
        release(near, spread, shape)
        n_now = now.count()
        found = now if found is None else found.unionByName(now)
        if not n_now or iteration == max_iterations:
            break
        n_found += n_now
        small = F.broadcast if n_found <= BROADCAST_ROWS else lambda df: df
        going = join_null_safe(rows, small(now.select("series").distinct()), ["series"], "left_semi")
        left = join_null_safe(going, small(found.select("series", "pos", "u")), ["series", "pos", "u"], "left_anti")
    return found


def _middle(x: np.ndarray, seg: np.ndarray, n: int) -> np.ndarray:
    """Lower median of |x| in each of n segments, NaN left out; NaN where nothing is left."""
    keep = ~np.isnan(x)
    x, seg = np.abs(x[keep]), seg[keep]
    x = x[np.lexsort((x, seg))]
    size = np.bincount(seg, minlength=n)
    first = np.cumsum(size) - size
    out = np.full(n, np.nan)
    out[size > 0] = x[(first + (size - 1) // 2)[size > 0]]
    return out


def _spikes_of_series(series: np.ndarray, pos: np.ndarray, u: np.ndarray, limit: float, most: int | None) -> np.ndarray:
    """Iteration (0: none) of each row of whole series in (series, pos) order, as phase_space_spikes defines it."""
    out = np.zeros(len(u), dtype=np.int32)
    rows = np.flatnonzero(~np.isnan(u))
    for iteration in count(1) if most is None else range(1, most + 1):
        if not len(rows):
            break
        s, p, own = series[rows], pos[rows], u[rows]
        new = np.r_[True, (s[1:] != s[:-1]) | (p[1:] != p[:-1])]
        run = np.cumsum(new) - 1
        finite = np.isfinite(own)
        size = np.bincount(run, finite)
        m = np.bincount(run, np.where(finite, own, 0.0)) / np.where(size > 0, size, np.nan)
        of = s[new]
        _, of = np.unique(of, return_inverse=True)
        has = size > 0  # a run whose rows are all infinite has no mean and no neighbours
        m, of, back = m[has], of[has], np.flatnonzero(has)
        n_series = int(of.max()) + 1 if len(of) else 0
        before, after = np.full(len(m), np.nan), np.full(len(m), np.nan)
        same = of[1:] == of[:-1]
        before[1:][same], after[:-1][same] = m[:-1][same], m[1:][same]
        d1, d2 = (after - before) / 2, after - 2 * m + before
        s1, s2 = MAD_TO_SD * _middle(d1, of, n_series), MAD_TO_SD * _middle(d2, of, n_series)
        n = np.bincount(of, minlength=n_series)
        with np.errstate(divide="ignore", invalid="ignore"):
            z1 = np.where(s1[of] > 0, d1 / s1[of], np.nan)
            z2 = np.where(s2[of] > 0, d2 / s2[of], np.nan)
            a, b = _middle(m + z2, of, n_series) ** 2, _middle(m - z2, of, n_series) ** 2
            rho = np.nan_to_num(np.clip((a - b) / (a + b), -0.99, 0.99))
            axis = np.minimum(limit, np.sqrt(2 * np.log(n / FALSE_SPIKES)))
        wide = lambda x, fill: np.where(np.isin(run, back), x[np.searchsorted(back, run).clip(0, max(len(x) - 1, 0))], fill) if len(x) else np.full(len(run), fill)  # noqa: B023, E731
        z1r, z2r, rr, cr = wide(np.nan_to_num(z1), 0.0), wide(z2, np.nan), wide(rho[of], 0.0), wide(axis[of], limit)
        with np.errstate(invalid="ignore"):
            plane = (own**2 - 2 * rr * own * z2r + z2r**2) / (1 - rr**2)
            outside = ~finite | (np.where(np.isnan(plane), own**2, plane) + z1r**2 > cr**2)
        if not outside.any():
            break
        out[rows[outside]] = iteration
        going = np.isin(s, s[outside]) & ~outside
        rows = rows[going]
    return out


def _equal_runs(series: np.ndarray, pos: np.ndarray, value: np.ndarray, known: np.ndarray, least: int) -> np.ndarray:
    """Whether each row of whole series in (series, pos) order lies in a row of at least ``least`` equal runs."""
    new = np.r_[True, (series[1:] != series[:-1]) | (pos[1:] != pos[:-1])]
    run, first = np.cumsum(new) - 1, np.flatnonzero(new)
    equal = (value == value[first][run]) | (np.isnan(value) & np.isnan(value[first][run]))
    whole = np.bincount(run, ~(equal & known)) == 0
    v, s = value[first], series[first]
    goes_on = (s[1:] == s[:-1]) & whole[1:] & whole[:-1] & ((v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1])))
    seg = np.cumsum(np.r_[True, ~goes_on]) - 1
    return (whole & (np.bincount(seg)[seg] >= least))[run]


def _scores(group: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(robust score, number of levels) of each row within its group; NaN where it has no level."""
    keep = np.flatnonzero(~np.isnan(level))
    n = int(group.max()) + 1 if len(group) else 0
    size = np.bincount(group[keep], minlength=n)

    def medians(x: np.ndarray) -> np.ndarray:
        x, first = x[np.lexsort((x, group[keep]))], np.cumsum(size) - size
        out, some = np.full(n, np.nan), size > 0
        out[some] = (x[(first + (size - 1) // 2)[some]] + x[(first + size // 2)[some]]) / 2
        return out

    off = level[keep] - medians(level[keep])[group[keep]]
    sd = MAD_TO_SD * medians(np.abs(off))[group[keep]]
    score = np.full(len(level), np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        score[keep] = np.where(sd > 0, off / sd, np.where(off == 0, 0.0, np.sign(off) * np.inf))
    return score, size[group] if n else size


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _flag_whole_series(rows: DataFrame, limit: float, stuck_length: int, most: int | None, piece: int) -> DataFrame:
    """Flags of series that fit a task: one shuffle by series, then every statistic over arrays of whole series."""
    kinds = dict(rows.dtypes)

    def flags(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        series = _codes(table["series"].combine_chunks())
        both = pa.StructArray.from_arrays([pa.array(series), pa.array(_codes(table["group"].combine_chunks()))], ["s", "g"])
        group = np.unique(np.stack([both.field("s").to_numpy(), both.field("g").to_numpy()]), axis=1, return_inverse=True)[1].ravel()
        known, placed = ~pc.is_null(table["value"]).to_numpy(), ~pc.is_null(table["pos"]).to_numpy()
        value = pc.fill_null(table["value"], 0.0).to_numpy()
        pos = pc.fill_null(table["pos"], 0).to_numpy()
        bad = known & ((value < 0) | np.isnan(value) | (value == np.inf))
        with np.errstate(invalid="ignore", divide="ignore"):
            score, size = _scores(group, np.where(known & ~bad, np.log10(value + 1), np.nan))
        stuck, iteration = np.zeros(len(value), dtype=bool), np.zeros(len(value), dtype=np.int32)
        if placed.any():
            stuck[placed] = _equal_runs(series[placed], pos[placed], value[placed], known[placed], stuck_length)
            iteration[placed] = _spikes_of_series(series[placed], pos[placed], score[placed], limit, most)
        iteration[~placed & (np.abs(np.nan_to_num(score, posinf=np.inf, neginf=-np.inf)) > limit)] = 1
        out = pa.table({
            "row_id": table["row_id"], "series": table["series"], "group": table["group"], "impossible": bad, "stuck": stuck,
            "spike_iteration": pa.array(iteration, mask=(iteration == 0) | bad), "score": pa.array(score, mask=np.isnan(score)),
            "n_group": pa.array(size.astype(np.int64), mask=bad),
        })
        return out.filter(pa.array(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < 2 * piece:
                continue
            table = pa.Table.from_batches(held)
            codes = _codes(table["series"].combine_chunks())
            cut = int(np.flatnonzero(codes != codes[-1])[-1]) + 1 if codes[0] != codes[-1] else 0
            if cut:
                yield from flags(table.slice(0, cut)).to_batches()
                held, n = table.slice(cut).to_batches(), table.num_rows - cut
        if n:
            yield from flags(pa.Table.from_batches(held)).to_batches()

    schema = f"row_id {kinds['row_id']}, series {kinds['series']}, `group` {kinds['group']}, impossible boolean, stuck boolean, spike_iteration int, score double, n_group bigint"
    return rows.repartition("series").sortWithinPartitions("series", "pos").mapInArrow(run, schema)


def _flag_in_pieces(rows: DataFrame, limit: float, stuck_length: int, most: int | None, piece: int, hot_limit: int) -> DataFrame:
    """Flags of series longer than a task holds: medians by hot groups, orders by pieces, spikes by rounds."""
    x = F.col("value")
    bad = (x < 0) | F.isnan(x) | (x == float("inf"))
    rows = rows.withColumn("impossible", bad).withColumn("level", F.when(~bad, F.log10(x + 1)))
    rows = with_median_mad(rows, ["series", "group"], ["level"], hot_limit=hot_limit)
    off, sd = F.col("level") - F.col("med_level"), MAD_TO_SD * F.col("mad_level")
    rows = cut_lineage(rows.withColumn("score", F.when(sd > 0, off / sd).when(off == 0, 0.0).when(off.isNotNull(), F.signum(off) * float("inf"))))

    same = F.min("value").eqNullSafe(F.max("value")) & (F.count("value") == F.count(F.lit(1)))
    runs = rows.where(F.col("pos").isNotNull()).groupBy("series", "pos").agg(F.when(same, F.min("value")).alias("value"))
    runs = cut_pieces(runs, "pos", piece)
    stuck = stuck_runs(runs, stuck_length).withColumn("stuck", F.lit(True))
    rows = join_counted(rows, stuck, ["series", "pos"])
    if most == 0:
        rows = rows.withColumn("iteration", F.lit(None).cast("int"))
    else:
        readings = rows.where(F.col("pos").isNotNull() & (F.abs("score") < float("inf"))).groupBy("series", "pos", F.col("score").alias("u")).agg(F.count(F.lit(1)).alias("copies"))
        readings = join_null_safe(readings, runs.select("series", "pos", "piece"), ["series", "pos"])
        spikes = phase_space_spikes(cut_lineage(readings.withColumn("u", F.explode(F.array_repeat("u", F.col("copies").cast("int"))))), limit=limit, max_iterations=most)
        spikes = spikes.select("series", "pos", F.col("u").alias("score"), F.col("iteration"))
        rows = join_counted(rows, spikes, ["series", "pos", "score"])
    alone = (F.abs("score") == float("inf")) | (F.col("pos").isNull() & (F.abs("score") > limit))
    return rows.where(x.isNotNull()).select(
        "row_id", "series", "group", "impossible", F.coalesce("stuck", F.lit(False)).alias("stuck"),
        F.when(~F.col("impossible"), F.when(alone, 1).otherwise(F.col("iteration"))).alias("spike_iteration"), "score",
        F.when(~F.col("impossible"), F.col("n_level")).alias("n_group"),
    )


def flag_readings(
    df: DataFrame,
    *,
    row_id: str,
    value: str,
    series: str,
    order: str,
    group: str,
    limit: float = 6.0,
    stuck_length: int = 5,
    max_iterations: int | None = None,
    piece: int = PIECE,
    hot_limit: int = HOT_ROWS,
) -> DataFrame:
    """Flags per row with a non-null value: row_id, series, group, impossible, stuck, spike_iteration, score, n_group.

    impossible: negative, NaN or infinite. stuck: in a row of at least ``stuck_length`` neighbouring runs of one series with
    exactly the same value; rows with one order value are one run, a run whose rows disagree or lack a value ends the
    row. score: robust standard deviations of log10(value + 1) off the median of its series and group (over all
    possible readings; infinite where the group has no spread and the reading is off the median). spike_iteration: the
    round in which phase_space_spikes finds the row. An infinite score is found in round 1 and takes no part in the
    run's mean; rows without order have no differences and are held against ``limit`` alone. Null series and groups
    form a series and a group of their own; rows with a null value are left out; repeated rows are each reported.

    Series of at most ``piece`` rows are shuffled once, by series, and flagged whole in the task that gets them;
    longer ones, at most rows/piece, are cut into pieces and share their medians and rounds between tasks. With
    ``max_iterations`` 0 no ellipsoid is formed, and spike_iteration tells only of rows without place or finite score.
    """
    names = {"row_id": row_id, "series": series, "group": group}
    rows = df.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()], F.col(order).cast("bigint").alias("pos"), F.col(value).cast("double").alias("value"))
    long = cut_lineage(hot_keys(rows, ["series"], piece))
    if long.isEmpty():
        return _flag_whole_series(rows, limit, stuck_length, max_iterations, piece)
    long = F.broadcast(long)
    short = _flag_whole_series(join_null_safe(rows, long, ["series"], "left_anti"), limit, stuck_length, max_iterations, piece)
    return short.unionByName(_flag_in_pieces(join_null_safe(rows, long, ["series"], "left_semi"), limit, stuck_length, max_iterations, piece, hot_limit))


def implausible(flags: DataFrame, *, limit: float = 6.0, min_group: int = 12) -> DataFrame:
    """Rows that are impossible, stuck, or more than ``limit`` robust standard deviations off their group's median, in
    groups of at least ``min_group`` readings.

    Such a row lies outside the phase-space ellipsoid whatever its neighbours are, as the ellipsoid's shadow on the value
    axis is at most ``limit``; so no round of it can add a row here or take one away, and none is needed
    (flag_readings with max_iterations=0).
    """
    spike = (F.abs("score") > limit) & (F.col("n_group") >= min_group)
    return flags.where(F.col("impossible") | F.col("stuck") | F.coalesce(spike, F.lit(False)))

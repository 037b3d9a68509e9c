"""From scored pairs to the pairs that are kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.expressions import f_half, logit_shift
from millrace.operators.grouping import best_in_group, ranked

FLOOR = 0.003
#: What a distribution may lose at its ends at a time; elements worked out at once.
TAIL, AT_ONCE = 1e-18, 1 << 20


def partition(pairs: DataFrame, score: str, record: list[str], entity: str) -> DataFrame:
    """Each record's best entity; ties go to the smaller entity."""
    return best_in_group(pairs, record, score, entity)


def _joint(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    """The distribution (first count, probabilities) of a sum of two independent counts, without ends that weigh nothing."""
    p = np.convolve(a[1], b[1])
    low = int(np.searchsorted(np.cumsum(p), TAIL, "right"))
    high = len(p) - int(np.searchsorted(np.cumsum(p[::-1]), TAIL, "right"))
    return a[0] + b[0] + low, p[low:high]


def _repeated(p: float, n: int) -> tuple[int, np.ndarray]:
    """The distribution of n independent events of probability p."""
    out, square = (0, np.ones(1)), (0, np.array([1 - p, p]))
    while n:
        if n & 1:
            out = _joint(out, square)
        n >>= 1
        square = _joint(square, square) if n else square
    return out


def _without_one(runs: list[tuple[float, int]]):
    """For each run (p, n) in turn the distribution of all events but one of it. No step divides, so none loses digits."""
    whole = {}

    def build(a, b):
        m = (a + b) // 2
        whole[a, b] = _repeated(*runs[a]) if b - a == 1 else _joint(build(a, m), build(m, b))
        return whole[a, b]

    def walk(a, b, rest):
        if b - a == 1:
            yield _joint(rest, _repeated(runs[a][0], runs[a][1] - 1))
            return
        m = (a + b) // 2
        yield from walk(a, m, _joint(rest, whole[m, b]))
        yield from walk(m, b, _joint(rest, whole[a, m]))

    build(0, len(runs))
    return walk(0, len(runs), (0, np.ones(1)))


def prefix_of(runs: list[tuple[float, int]]) -> tuple[int, float]:
    """(k, ef) of best_prefix for events of probability p that come n times each (runs, descending).

    With S all that come true, the first k have 1.25 a / (0.25 S + k) on average: the sum over s of E[a; S = s] * 5 / (s + 4 k).
    E[a; S = s] grows by p * P(the others = s - 1) with each event, which is the same within a run. All k are tried.
    """
    runs = [r for r in runs if r[1] > 0]
    if not runs:
        return 0, 1.0
    others = list(_without_one(runs))
    low, high = min(o[0] for o in others) + 1, max(o[0] + len(o[1]) for o in others) + 1
    s, sums = np.arange(low, high), np.zeros((high - low, 2))  # what the runs before have, what one more event brings
    options, k = [np.array([np.prod([(1 - p) ** n for p, n in runs])])], 0
    for (p, n), (first, rest) in zip(runs, others, strict=True):
        sums[:, 1] = 0
        sums[first + 1 - low : first + 1 - low + len(rest), 1] = p * rest
        step = max(1, AT_ONCE // len(s))
        for a in range(0, n, step):
            j = np.arange(a + 1, min(a + step, n) + 1)
            x = (5 / (s[None, :] + 4 * (k + j)[:, None])) @ sums
            options.append(x[:, 0] + j * x[:, 1])
        sums[:, 0] += n * sums[:, 1]
        k += n
    options = np.round(np.concatenate(options), 9)
    best = int(np.argmax(options))
    return best, float(options[best])


def _prefixes(ps: pa.Array, counts: pa.Array) -> pa.Array:
    found = [prefix_of(list(zip(p or [], n or [], strict=True))) for p, n in zip(ps.to_pylist(), counts.to_pylist(), strict=True)]
    return pa.array([{"k": k, "ef": ef} for k, ef in found], pa.struct([("k", pa.int32()), ("ef", pa.float64())]))


def best_prefix(ps, counts=None):
    """Struct (k, ef): the prefix length of greatest expected F0.5 (the smallest of equals) and that expectation.

    ps are descending probabilities, of any number; counts say how often each comes, once without them."""
    best = F.arrow_udf(_prefixes, "struct<k:int,ef:double>")(ps, F.transform(ps, lambda _: F.lit(1)) if counts is None else counts)
    # never null, and said to be so: a test for null would be pushed down and work the lists out twice
    return F.struct(F.coalesce(best["k"], F.lit(0)).alias("k"), F.coalesce(best["ef"], F.lit(1.0)).alias("ef"))


def best_prefixes(pairs: DataFrame, score: str, entity: list[str], name: str) -> DataFrame:
    """(*entity, name): best_prefix of all pairs of each entity. An entity's list has its different scores and how often each
    comes; it is worked out once for each different list."""
    runs = pairs.groupBy(*entity, F.col(score).cast("double").alias("p")).agg(F.count("*").alias("n"))
    lists = runs.groupBy(*entity).agg(F.sort_array(F.collect_list(F.struct("p", "n")), asc=False).alias("_runs"))
    each = lists.select(F.col("_runs").alias("_list")).distinct().repartition("_list")
    each = each.withColumn(name, best_prefix(F.col("_list.p"), F.col("_list.n")))
    return lists.join(each, F.col("_runs") == F.col("_list")).drop("_list", "_runs")


def select_expected_f(pairs: DataFrame, score: str, entity: list[str], *ties: str, floor: float = FLOOR) -> DataFrame:
    """The pairs of each entity's best prefix: of its pairs of score >= floor, from the best on, the first k that together
    have the greatest expected F0.5, however many they are."""
    some = pairs.filter(F.col(score) >= floor)
    best = best_prefixes(some, score, entity, "_best").select(*entity, F.col("_best.k").alias("_k"))
    chosen = some.withColumn("_rk", ranked(entity, score, *ties)).join(best, entity)
    return chosen.filter(F.col("_rk") <= F.col("_k")).drop("_rk", "_k")


def per_entity(pred: DataFrame, truth: DataFrame, universe: DataFrame, entity: str, record: list[str], grid: tuple[str, list[float]] | None = None) -> DataFrame:
    """(entity, n_true, n_pred, tp, f) for every entity of the universe, by one aggregation of a union.

    Pairs outside the universe and repeated pairs don't count. grid: a column of pred, and its few values, by which it
    is evaluated apart.
    """
    keys = [grid[0], entity] if grid else [entity]
    marked = pred.select(*keys, *record).distinct().withColumn("_p", F.lit(1)).withColumn("_t", F.lit(0))
    known = truth.select(entity, *record).distinct()
    universe = universe.select(entity).distinct()
    if grid:
        values = F.explode(F.array(*map(F.lit, grid[1])))
        known, universe = known.withColumn(grid[0], values), universe.withColumn(grid[0], values)
    known = known.select(*keys, *record, F.lit(0).alias("_p"), F.lit(1).alias("_t"))
    both = marked.unionByName(known).groupBy(*keys, *record).agg(F.max("_p").alias("_p"), F.max("_t").alias("_t"))
    counts = both.groupBy(*keys).agg(F.sum("_t").alias("n_true"), F.sum("_p").alias("n_pred"), F.sum(F.col("_p") * F.col("_t")).alias("tp"))
    out = universe.select(*keys).join(counts, keys, "left").na.fill(0, ["n_true", "n_pred", "tp"])
    return out.withColumn("f", f_half(F.col("tp"), F.col("n_true"), F.col("n_pred")))


def per_entity_counted(pred: DataFrame, n_true: DataFrame, universe: DataFrame, entity: str, record: list[str], hit, grid: tuple[str, list[float]] | None = None) -> DataFrame:
    """per_entity where the truth comes as counts (entity, n_true), and `hit` tells of a pair of pred whether it is true."""
    keys = [grid[0], entity] if grid else [entity]
    made = pred.select(*keys, *record, hit.alias("_hit")).distinct().groupBy(*keys).agg(F.count("*").alias("n_pred"), F.count_if("_hit").alias("tp"))
    out = universe.select(entity).distinct().join(n_true, entity, "left")
    if grid:
        out = out.withColumn(grid[0], F.explode(F.array(*map(F.lit, grid[1]))))
    out = out.join(made, keys, "left").na.fill(0, ["n_true", "n_pred", "tp"])
    return out.select(*keys, "n_true", "n_pred", "tp").withColumn("f", f_half(F.col("tp"), F.col("n_true"), F.col("n_pred")))


def sweep_thresholds(pairs: DataFrame, score: str, thresholds: list[float]) -> DataFrame:
    """The pairs that each threshold keeps: one pass, the few thresholds ride along as an array."""
    grid = F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col(score) >= t)
    return pairs.withColumn("threshold", F.explode(grid))


def sweep_shifts(pairs: DataFrame, score: str, deltas: list[float]) -> DataFrame:
    """The pairs once for each delta, their score shifted on the logit scale."""
    return pairs.withColumn("delta", F.explode(F.array(*map(F.lit, deltas)))).withColumn(score, logit_shift(F.col(score), F.col("delta")))

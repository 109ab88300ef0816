"""Evaluation of rankings: hit rates, baselines, blends, conformal sets, attributions, a linear ranker."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written
from .relational import number_rows


def with_candidates(picks: DataFrame, cohort: list[str], window: int, scores: list[str]) -> DataFrame:
    """Adds ``candidates``: the scores of the pick and the ``window`` picks after it; linear in the picks.

    ``overall_pick`` numbers each cohort without gaps. A task holds a block of a cohort, not the whole.
    """
    rows = in_blocks(picks, cohort, window)
    frame = W.partitionBy(*cohort, "_block").orderBy("overall_pick").rowsBetween(0, window)
    return rows.withColumn("candidates", F.collect_list(F.struct(*scores)).over(frame)).where(~F.col("_halo")).drop("_block", "_halo")


def in_blocks(picks: DataFrame, cohort: list[str], window: int, size: int = 4096) -> DataFrame:
    """Adds ``_block`` (a range of overall_pick) and ``_halo``: the first ``window`` picks of a block come once more, as the end of the one before."""
    pick, block = F.col("overall_pick"), F.floor(F.col("overall_pick") / size)
    first = (pick % size < window) & (block > 0)
    own = F.struct(block.alias("_block"), F.lit(False).alias("_halo"))
    halo = F.when(first, F.struct((block - 1).alias("_block"), F.lit(True).alias("_halo")))
    return picks.select("*", F.inline(F.array_compact(F.array(own, halo))))


def rank_of_actual(score: Column, candidate_score) -> Column:
    """Place of the pick itself among its candidates; it stands first among ties."""
    return F.size(F.filter("candidates", lambda c: candidate_score(c) > score)) + 1


def hit_metrics(rank: Column, digits: int = 6) -> list[Column]:
    """n, top1, top3, top5, mrr."""
    rate = lambda k: F.round(F.avg(F.when(rank <= k, 1.0).otherwise(0.0)), digits).alias(f"top{k}")
    return [F.count("*").alias("n"), rate(1), rate(3), rate(5), F.round(F.avg(1 / rank), digits).alias("mrr")]


def breakdown(ranks: DataFrame, rank: str, dimensions: list[str]) -> DataFrame:
    """dimension, value and metrics: all together and by each dimension, in one pass (grouping sets)."""
    sets = [[], *[[d] for d in dimensions]]
    out = ranks.groupingSets([[F.col(c) for c in s] for s in sets], *dimensions).agg(F.grouping_id().alias("g"), *hit_metrics(F.col(rank)))
    top = 2 ** len(dimensions) - 1
    name, value = F.lit("all"), F.lit("")
    for i, d in enumerate(dimensions):
        is_d = F.col("g") == top - 2 ** (len(dimensions) - 1 - i)
        name, value = F.when(is_d, d).otherwise(name), F.when(is_d, F.col(d).cast("string")).otherwise(value)
    return out.select(name.alias("dimension"), value.alias("value"), "n", "top1", "top3", "top5", "mrr")


def random_baseline(pool_size: Column, digits: int = 6) -> list[Column]:
    """Expected metrics of a random order: 1/n, min(k, n)/n, harmonic(n)/n."""
    n = pool_size.cast("double")
    rate = lambda k: F.round(F.avg(F.least(F.lit(float(k)), n) / n), digits).alias(f"top{k}")
    harmonic = F.aggregate(F.sequence(F.lit(1), pool_size), F.lit(0.0), lambda a, i: a + 1 / i)
    return [F.count("*").alias("n"), rate(1), rate(3), rate(5), F.round(F.avg(harmonic / n), digits).alias("mrr")]


def group_hit_rate(rows: DataFrame, group: str, label: str, score: str, tie: str) -> DataFrame:
    """group, n, hit: does the best scored row of a group with any positive have the label?"""
    best = F.max_by(label, F.struct(score, F.col(tie)))
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.max(label).alias("any"), best.alias("hit")).where("any = 1").drop("any")


def softmax_shares(rows: DataFrame, group: str, score: str) -> DataFrame:
    """Adds ``share``: the softmax of the score in its group, from two aggregates of the group."""
    top = rows.groupBy(group).agg(F.max(score).alias("_top"))
    shifted = rows.join(top, group).withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    total = shifted.groupBy(group).agg(F.sum("_e").alias("_sum"))
    return shifted.join(total, group).withColumn("share", F.col("_e") / F.col("_sum")).drop("_e", "_top", "_sum")


def conformal_quantiles(rows: DataFrame, group: str, label: str, score: str, alphas=(0.10, 0.15, 0.20)) -> DataFrame:
    """alpha, threshold, n, nc_mean, nc_std of the groups' nonconformity (1 less the best positive's share).

    The threshold is the order statistic k = ceil((n + 1)(1 - alpha)), at most n: the finite-sample quantile.
    """
    nc = softmax_shares(rows, group, score).where(F.col(label) == 1).groupBy(group).agg((1 - F.max("share")).alias("nc"))
    placed = number_rows(nc, [], F.floor(F.col("nc") * 10_000), [F.col("nc")], "place")
    stats = placed.agg(F.count("*").alias("n"), F.round(F.avg("nc"), 6).alias("nc_mean"), F.round(F.stddev_pop("nc"), 6).alias("nc_std"))
    levels = rows.sparkSession.createDataFrame([(a,) for a in alphas], "alpha double")
    wanted = stats.crossJoin(F.broadcast(levels)).withColumn("k", F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.round((F.col("n") + 1) * (1 - F.col("alpha")), 9)))))
    return placed.join(F.broadcast(wanted), F.col("place") == F.col("k")).select("alpha", F.round("nc", 6).alias("threshold"), "n", "nc_mean", "nc_std")


def conformal_sets(rows: DataFrame, group: str, score: str, thresholds: DataFrame, alpha: float) -> DataFrame:
    """Adds nc and in_set: is the row plausible at the level?"""
    t = F.broadcast(thresholds.where(F.col("alpha") == alpha).select("threshold"))
    return softmax_shares(rows, group, score).crossJoin(t).withColumn("nc", F.round(1 - F.col("share"), 6)).withColumn("in_set", F.col("nc") <= F.col("threshold"))


def linear_attribution(rows: DataFrame, key: str, weights: dict[str, float], means: DataFrame, top: int = 10) -> DataFrame:
    """key, feature, contribution, place: w (x - mean) of the features that matter most; they sum to the score less its mean."""
    parts = [F.struct(F.lit(f).alias("feature"), F.round(F.lit(w) * (F.col(f) - F.col(f"mean_{f}")), 6).alias("contribution")) for f, w in weights.items()]
    order = lambda a, b: (
        F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1).when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1)
        .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0)
    )
    out = rows.crossJoin(F.broadcast(means)).select(key, F.posexplode(F.slice(F.array_sort(F.array(*parts), order), 1, top)).alias("place", "c"))
    return out.select(key, "c.feature", "c.contribution", (F.col("place") + 1).alias("place"))


def pairwise_ranker(pairs: DataFrame, features: list[str], weight: str | None = None, ridge: float = 1e-3) -> dict[str, float]:
    """A linear ranker: logistic regression without intercept on differences of feature vectors.

    ``pairs`` has for each feature the value of the chosen less that of the one passed over. The loss is the mean of weighted losses
    and ridge / 2 times the squared weights of the features as they are.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    return pairwise_rankers(pairs.select(*[F.col(f"`{f}`") for f in features], w.alias("_w"), F.lit(0).alias("_at")), features, "_w", "_at", [0], ridge)[0]


def pairwise_rankers(pairs: DataFrame, features: list[str], weight: str, at: str, lasts: list[int], ridge: float = 1e-3, rounds: int = 50) -> list[dict[str, float]]:
    """``pairwise_ranker`` of the pairs whose ``at`` is at most each of ``lasts``, all by Newton's method in the same passes.

    A pass brings a model's loss, gradient and second derivatives to the driver, summed over the tasks in their order: features x features numbers. A step that does not lower the loss is halved.
    """
    k = len(features)
    rows = pairs.select(*[F.col(f"`{f}`").cast("double").alias(f"d{i}") for i, f in enumerate(features)], F.col(weight).cast("double").alias("w"), F.col(at).cast("int").alias("at"))

    def parts(batch):
        yield np.stack([batch.column(f"d{i}").to_numpy(zero_copy_only=False) for i in range(k)], axis=1), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("w", "at"))

    return _newton(rows, parts, features, lasts, ridge, rounds)


def _newton(rows: DataFrame, parts, features: list[str], lasts: list[int], ridge: float, rounds: int) -> list[dict[str, float]]:
    """``parts`` gives (differences, weights, at) of a batch of ``rows``."""
    k = len(features)

    def sums(thetas: dict[int, np.ndarray]) -> dict[int, tuple]:
        def run(batches):
            total = {i: np.zeros(2 + k + k * k) for i in thetas}
            for batch in batches:
                for x, w, year in parts(batch):
                    for i, theta in thetas.items():
                        used = year <= lasts[i]
                        d, v = (x, w) if used.all() else (x[used], w[used])
                        if not len(d):
                            continue
                        m = d @ theta
                        p = 0.5 * (1 - np.tanh(m / 2))  # 1 / (1 + exp(m))
                        total[i] += np.concatenate([[v.sum(), v @ np.logaddexp(0, -m)], -(v * p) @ d, (d.T @ (d * (v * p * (1 - p))[:, None])).reshape(-1)])
            task = pa.array([TaskContext.get().partitionId()] * len(total), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), task, pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["model", "task", "sums"])

        def add(batches):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for model, x in zip(batch.column("model").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                    total[model] = total.get(model, 0) + np.frombuffer(x)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["model", "sums"])

        of_tasks = rows.mapInArrow(run, "model int, task int, sums binary").repartition("model").sortWithinPartitions("model", "task")
        out = {r.model: np.frombuffer(r.sums) for r in of_tasks.mapInArrow(add, "model int, sums binary").collect()}
        found = {}
        for i, t in out.items():
            n = t[0] or 1.0
            found[i] = (t[1] / n + ridge / 2 * thetas[i] @ thetas[i], t[2 : 2 + k] / n + ridge * thetas[i], t[2 + k :].reshape(k, k) / n + ridge * np.eye(k))
        return found

    best = {i: (np.inf, np.zeros(k), np.zeros(k)) for i in range(len(lasts))}  # loss, theta, the step to try
    result = {i: np.zeros(k) for i in best}
    for _ in range(rounds):
        got = sums({i: theta + step for i, (_, theta, step) in best.items()})
        for i, (loss, gradient, second) in got.items():
            before, theta, step = best[i]
            if loss > before + 1e-12:
                best[i] = (before, theta, step / 2)
            else:
                theta = theta + step
                best[i] = (loss, theta, -np.linalg.solve(second, gradient))
            result[i] = best[i][1]
            if np.abs(best[i][2]).max(initial=0.0) < 1e-9:
                result[i] = best[i][1] + best[i][2]
                del best[i]
        best = {i: b for i, b in best.items() if i in got}  # a model without pairs keeps zeros
        if not best:
            break
    return [dict(zip(features, result[i].tolist(), strict=True)) for i in range(len(lasts))]


#: Rows of a block of whole groups.
GROUPED = 16_384


def grouped(rows: DataFrame, features: list[str], group: list[str], label: str, weight: str, at: str, row_id: str, near: Column | None = None) -> DataFrame:
    """The rows as a table of blocks of whole groups, for ``grouped_rankers``: each feature as its values in the block and a code a row.

    Rows are shuffled once; pairs are formed where a block is read and held by no table. ``row_id`` is a whole number. Groups that are equal in ``near`` (a value of
    the group) lie together, so that a block has fewer values.
    """
    n_tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select(
        F.xxhash64(*([F.lit(0) if at not in group else F.col(at), near] if near is not None else group)).alias("b"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(group)],
        F.col(label).cast("int").alias("l"), F.col(weight).cast("double").alias("w"), F.col(at).cast("int").alias("at"), F.col(row_id).cast("bigint").alias("r"), *[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)],
    )
    keys = ["b", *[f"k{i}" for i in range(len(group))]]

    def starts_of(table: pa.Table) -> np.ndarray:
        new = np.ones(table.num_rows, bool)
        new[1:] = False
        for c in keys:
            code = table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    def block(table: pa.Table) -> pa.RecordBatch:
        values, codes = [], []
        for i in range(len(features)):
            v, c = np.unique(table.column(f"x{i}").to_numpy(), return_inverse=True)
            values.append(v.astype(np.float64))
            codes.append(c.astype(np.uint8 if len(v) <= 256 else np.uint16 if len(v) <= 65_536 else np.uint32).tobytes())
        plain = [table.column(c).to_numpy().astype(t) for c, t in (("l", np.int8), ("w", np.float64), ("at", np.int32), ("r", np.int64))]
        packed = [starts_of(table).astype(np.int32).tobytes(), *(x.tobytes() for x in plain)]
        lists = [pa.array([[v.tobytes() for v in values]], pa.list_(pa.binary())), pa.array([codes], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays([pa.array([table.num_rows], pa.int32()), *(pa.array([x], pa.binary()) for x in packed), *lists], names=_GROUPED_NAMES)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= GROUPED:  # the last group may go on: it starts the next block
                table = pa.Table.from_batches(held)
                cut = int(starts_of(table)[-1])
                if cut:
                    yield block(table.slice(0, cut).combine_chunks())
                    held, size = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
        if size:
            yield block(pa.Table.from_batches(held).combine_chunks())

    dealt = keyed.where(F.col("l").isNotNull()).repartition(n_tasks, "b").sortWithinPartitions(*keys, "r")
    return written(dealt.mapInArrow(run, _GROUPED), "evaluate-groups")


_GROUPED = "n int, starts binary, labels binary, weights binary, at binary, ids binary, values array<binary>, codes array<binary>"
_GROUPED_NAMES = [x.split(" ")[0] for x in _GROUPED.split(", ")]


def _blocks_of(batch):
    """Starts of the groups, labels, weights, at, ids and features (rows x features) of each block of a batch."""
    for row in batch.to_pylist():
        plain = [np.frombuffer(row[c], t) for c, t in (("starts", np.int32), ("labels", np.int8), ("weights", np.float64), ("at", np.int32), ("ids", np.int64))]
        n = row["n"]
        x = np.empty((len(row["values"]), n))
        for i, (v, c) in enumerate(zip(row["values"], row["codes"], strict=True)):
            x[i] = np.frombuffer(v)[np.frombuffer(c, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(c) // n])]
        yield (*plain, np.ascontiguousarray(x.T))


def grouped_rankers(blocks: DataFrame, features: list[str], lasts: list[int], ridge: float = 1e-3, rounds: int = 50) -> list[dict[str, float]]:
    """``pairwise_rankers`` of each row with label 1 less each with label 0 of its group, weighed as the former, from the table of ``grouped``."""

    def parts(batch):
        for starts, labels, weights, at, _, x in _blocks_of(batch):
            ends = np.r_[starts[1:], len(labels)]
            of = np.repeat(np.arange(len(starts)), ends - starts)
            chosen = np.flatnonzero(labels == 1)
            sizes = (ends - starts)[of[chosen]]
            better = np.repeat(chosen, sizes)
            worse = np.repeat(starts[of[chosen]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(better))
            real = labels[worse] == 0
            better, worse = better[real], worse[real]
            yield x[better] - x[worse], weights[better], at[better]

    return _newton(blocks, parts, features, lasts, ridge, rounds)


def grouped_hits(blocks: DataFrame, features: list[str], models: dict[int, dict[str, float]]) -> dict[int, tuple[int, float, float]]:
    """For each ``at`` of ``models``: groups with a label 1, in what share of them the best scored row has it (see ``group_hit_rate``), and the mean of 1 / rows of them."""
    thetas = {at: np.array([w[f] for f in features]) for at, w in models.items()}

    def run(batches):
        total = {at: np.zeros(3) for at in thetas}
        for batch in batches:
            for starts, labels, _, at, ids, x in _blocks_of(batch):
                sizes = np.diff(np.r_[starts, len(labels)])
                of = np.repeat(np.arange(len(starts)), sizes)
                score = np.zeros(len(labels))
                for a in set(np.unique(at).tolist()) & set(thetas):
                    score[at == a] = np.round(x[at == a] @ thetas[a], 12)
                best = np.lexsort((ids, score, of))[np.cumsum(sizes) - 1]
                asked = np.maximum.reduceat(labels, starts) == 1
                for a in total:
                    here = asked & (at[starts] == a)
                    total[a] += [here.sum(), (labels[best[here]] == 1).sum(), (1 / sizes[here]).sum()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), *(pa.array([float(t[i]) for t in total.values()], pa.float64()) for i in range(3))], names=["at", "n", "hits", "chance"])

    found = blocks.mapInArrow(run, "at int, n double, hits double, chance double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("chance").alias("chance")).collect()
    return {r["at"]: (int(r.n), r.hits / r.n if r.n else None, r.chance / r.n if r.n else None) for r in found}


def walk_forward(years: list[int], first: int) -> list[tuple[int, int]]:
    """(last training year, test year) for every year from ``first`` on."""
    return [(y - 1, y) for y in years if y >= first]


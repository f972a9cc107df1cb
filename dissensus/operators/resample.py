"""Bootstrap intervals, repeated draws and upsampling.

Every draw is a function of the row key (``functions.rng``), so results do not
depend on partitioning and repeat on every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dissensus.functions import normal, rng
from dissensus.operators import nulls, ordering

CONFIDENCE = 0.95
N_RESAMPLES = 9999
# Tasks that the rows of a bootstrap are dealt to, per core.
TASKS_PER_CORE = 8


def replicate_sums(
    df: DataFrame, keys: list[str], value: str, row_key: list[Column], n_resamples: int, seed: str
) -> DataFrame:
    """Weighted sums of every bootstrap replicate: (keys, replicate, w, wx).

    A row takes part in a replicate Poisson(1) times. One hash serves four
    replicates. The partial sums of a map task replace its rows before the shuffle.
    """
    blocks = (n_resamples + 3) // 4
    rows = df.select(
        *keys, F.col(value).cast("double").alias("__x"), rng.key_text(F.lit(seed), *row_key).alias("__key")
    )
    # The work is a multiple of the rows: it is dealt to more tasks than a scan has.
    rows = rows.repartition(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, "__key", "__x")
    words = rows.select(
        *keys, "__x", "__key", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block")
    ).withColumn("__md5", rng.order_key(F.col("__key"), F.col("__block")))
    draws = words.select(
        *keys, "__block", "__x", *[F.substring("__md5", i * 8 + 1, 8).alias(f"__u{i}") for i in range(4)]
    )
    weights = draws.select(
        *keys, "__block", "__x", *[rng.poisson_of_word(F.col(f"__u{i}")).alias(f"__w{i}") for i in range(4)]
    )
    sums = weights.groupBy(*keys, "__block").agg(
        *[F.sum(f"__w{i}").alias(f"__w{i}") for i in range(4)],
        *[F.sum(F.col(f"__w{i}") * F.col("__x")).alias(f"__wx{i}") for i in range(4)],
    )
    replicates = F.array(
        *[
            F.struct(
                (F.col("__block") * 4 + i).alias("replicate"),
                F.col(f"__w{i}").alias("w"),
                F.col(f"__wx{i}").alias("wx"),
            )
            for i in range(4)
        ]
    )
    return sums.select(*keys, F.inline(replicates)).where(F.col("replicate") < n_resamples)


def bootstrap_mean(
    df: DataFrame,
    keys: list[str],
    value: str,
    row_key: list[Column],
    n_resamples: int = N_RESAMPLES,
    method: str = "BCa",
    confidence: float = CONFIDENCE,
    seed: str = "0",
) -> DataFrame:
    """Mean of each group with a bootstrap interval.

    ``method`` is ``percentile``, ``basic`` or ``BCa``. The result has one row per
    group: (keys, low, mean, high, confidence_level, n_samples). The replicate
    means of a group are ``n_resamples`` numbers, however many rows it has.
    """
    data = df.where(F.col(value).isNotNull())
    means = (
        replicate_sums(data, keys, value, row_key, n_resamples, seed)
        .where(F.col("w") > 0)
        .withColumn("m", F.col("wx") / F.col("w"))
    )
    stats = data.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.count(F.lit(1)).alias("n_samples"),
        *([F.skewness(value).alias("__skew")] if method == "BCa" else []),
    )
    alpha = (1 - confidence) / 2
    if method == "BCa":
        sorted_means = F.array_sort(F.collect_list("m")).alias("__means")
        both = join_on(stats, means.groupBy(*keys).agg(sorted_means), keys)
        out = with_bca_ends(both, alpha)
    else:
        ends = F.percentile("m", F.array(F.lit(alpha), F.lit(1 - alpha)))
        both = join_on(stats, means.groupBy(*keys).agg(ends.alias("__q")), keys)
        low, high = F.col("__q")[0], F.col("__q")[1]
        if method == "basic":
            low, high = 2 * F.col("mean") - high, 2 * F.col("mean") - low
        out = both.withColumns({"low": low, "high": high})
    return out.select(
        *keys, "low", "mean", "high", F.lit(confidence).alias("confidence_level"), "n_samples"
    )


def join_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two group tables; without keys both have one row."""
    return nulls.join(left, right, keys)


def with_bca_ends(groups: DataFrame, alpha: float) -> DataFrame:
    """Bias-corrected and accelerated interval ``low, high`` from a group's sorted
    replicate means in ``__means``.

    The jackknife of a mean needs no resampling: its acceleration is the skewness of the
    values over ``6 sqrt(n)``; that of a constant group, which has none, counts as 0.
    Where all replicates are on one side of the mean, their extremes are the interval.
    Each step is a column of its own, as the next one uses it many times.
    """
    means, mean, n = F.col("__means"), F.col("mean"), F.size("__means")
    below = F.size(F.filter(means, lambda m: m < mean)) + F.size(F.filter(means, lambda m: m <= mean))
    skew = F.when(F.isnan("__skew"), 0.0).otherwise(F.coalesce("__skew", F.lit(0.0)))
    out = groups.withColumns({"__share": below / (n * 2), "__a": skew / (F.sqrt("n_samples") * 6)})
    out = out.withColumn("__bias", normal.quantile(F.col("__share")))
    ends = {"low": alpha, "high": 1 - alpha}
    out = out.withColumns({f"__{e}_z": F.col("__bias") + normal.quantile(F.lit(p)) for e, p in ends.items()})
    out = out.withColumns({f"__{e}_x": F.col("__bias") + F.col(f"__{e}_z") / (1 - F.col("__a") * F.col(f"__{e}_z")) for e in ends})
    out = out.withColumns({f"__{e}_place": normal.cdf(F.col(f"__{e}_x")) * (n - 1) for e in ends})

    def at(end: str, extreme: Column) -> Column:
        place = F.col(f"__{end}_place")
        lower, upper = (F.get(means, side(place).cast("int")) for side in (F.floor, F.ceil))
        inside = (F.col("__share") > 0) & (F.col("__share") < 1)
        return F.when(inside, lower + (upper - lower) * (place - F.floor(place))).otherwise(extreme)

    return out.withColumns({"low": at("low", F.array_min(means)), "high": at("high", F.array_max(means))})


def cautious_mean(
    df: DataFrame, keys: list[str], value: str, row_key: list[Column], method: str = "basic", **kwargs
) -> DataFrame:
    """Mean with an interval that needs no correction terms, for groups of any size."""
    return bootstrap_mean(df, keys, value, row_key, method=method, **kwargs)


def simple_sampling(
    df: DataFrame,
    keys: list[str],
    item: list[str],
    run: list[Column],
    value: str,
    k: int = 100,
    seed: str = "0",
    bound: DataFrame | None = None,
) -> DataFrame:
    """One random run of every item, averaged, ``k`` times: (keys, draw, value).

    A row finds out by itself in which draws it is the chosen one, from its place
    in its item, so the draws multiply neither the rows nor the shuffle. ``bound`` is
    explained at ``ordering.large_groups``.
    """
    order = [rng.order_key(F.lit(seed), *[F.col(c) for c in item], *run), *run]
    placed = ordering.running_total(
        df.select(*dict.fromkeys([*keys, *item]), value, *run),
        item,
        order,
        name="__r",
        total="__n",
        bound=bound,
    )
    item_key = rng.key_text(F.lit(seed), *[F.col(c) for c in item])
    every = F.sequence(F.lit(0), F.lit(k - 1))
    chosen = placed.withColumn("__key", item_key).select(
        *keys,
        value,
        F.explode(
            # A single run needs no hash.
            F.when(F.col("__n") == 1, every).otherwise(
                F.filter(every, lambda d: F.floor(rng.uniform(F.col("__key"), d) * F.col("__n")) == F.col("__r"))
            )
        ).alias("draw"),
    )
    return chosen.groupBy(*keys, "draw").agg(F.avg(value).alias(value))


def best_of_n(
    df: DataFrame,
    item: list[str],
    run: list[Column],
    value: str,
    n_samples: int,
    k: int,
    score: str = "score",
    keys: list[str] | None = None,
    seed: str = "0",
    bound: DataFrame | None = None,
) -> DataFrame:
    """Value of the best-scored of ``n_samples`` random runs per item, averaged over
    the items, ``k`` times: (keys, n_samples, draw, value).

    Each map task keeps only its first ``n_samples`` runs of an (item, draw). Where
    ``bound`` shows that no item is large, rows go to their item's task before they are
    drawn, to so many tasks that the drawn rows are sorted in memory.
    """
    keys = keys or []
    names = dict.fromkeys([*keys, *item, value, score])
    rows = df.select(*names, F.struct(*run).alias("__run"))
    n = ordering.rows_if_small(bound, [*keys, *item])
    if n is not None:
        rows = rows.repartition(tasks_for(df, n * k), *dict.fromkeys([*keys, *item]))
    rows = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    order = rng.order_key(F.lit(seed), "draw_key", F.col("draw"), *[F.col(c) for c in item], F.to_json("__run"))
    group = list(dict.fromkeys([*keys, *item, "draw"]))
    taken = ordering.first_rows(rows.withColumn("__o", order), group, [F.col("__o"), F.col("__run")], n_samples)
    # Ties of the score go to the run that was drawn first.
    best = F.min_by(value, F.struct((-F.col(score)).alias("s"), F.col("__o").alias("o")))
    return (
        taken.groupBy(*group)
        .agg(best.alias(value))
        .groupBy(*keys, "draw")
        .agg(F.avg(value).alias(value))
        .withColumn("n_samples", F.lit(n_samples))
    )


def expected_best_of_n(
    df: DataFrame,
    item: list[str],
    tie: list[Column],
    value: str,
    sizes: list[int],
    score: str = "score",
) -> DataFrame:
    """Exact mean of ``best_of_n`` over all draws: (n_samples, value).

    Of N runs the one with the r-th best score is the best of n drawn without
    replacement with probability ``C(N-r, n-1) / C(N, n)``. Items with fewer runs
    than n contribute their best run, as a draw of all of them does.
    """
    data = df.select(*item, value, score, *tie)
    placed = ordering.running_total(data, item, [-F.col(score), *tie], name="__r", total="__n")
    sized = placed.withColumn("__size", F.explode(F.array(*[F.lit(n) for n in sizes])))
    n = F.least(F.col("__size").cast("bigint"), F.col("__n"))
    others = F.when(
        n > 1,
        F.aggregate(
            F.sequence(F.lit(0).cast("bigint"), n - 2),
            F.lit(1.0),
            lambda acc, j: acc
            * F.greatest(F.lit(0.0), (F.col("__n") - 1 - F.col("__r") - j).cast("double"))
            / (F.col("__n") - 1 - j),
        ),
    ).otherwise(1.0)
    share = sized.withColumn("__p", n / F.col("__n") * others)
    items = df.select(*item).distinct().agg(F.count(F.lit(1)).alias("__items"))
    sums = share.groupBy(F.col("__size").alias("n_samples")).agg(
        F.sum(F.col("__p") * F.col(value)).alias("__sum")
    )
    return sums.withColumn(value, F.col("__sum") / items.scalar()).select("n_samples", value)


def best_with_random_ties(
    df: DataFrame,
    keys: list[str],
    item: list[str],
    run: list[Column],
    value: str,
    k: int,
    score: str = "score",
    seed: str = "0",
    bound: DataFrame | None = None,
) -> DataFrame:
    """Value of the best-scored run per item, ties broken at random, ``k`` times.

    Only the runs that share an item's best score go into the draws. Where ``bound``
    shows that no item is large, a run is shuffled once (see ``best_in_place``).
    """
    group = list(dict.fromkeys([*keys, *item]))
    n = ordering.rows_if_small(bound, group) if k <= PLACE_DRAWS else None
    if n is not None:
        return best_in_place(df, keys, item, run, value, k, {score: F.lit(True)}, seed, n).select(
            *keys, F.inline(F.col(score))
        ).groupBy(*keys, "draw").agg(F.avg("value").alias(value))
    rows = df.select(*group, value, score, F.struct(*run).alias("__run"))
    best = rows.groupBy(*group).agg(F.max(score).alias("__best"))
    tied = nulls.join(rows, best, group).where(F.col(score).eqNullSafe(F.col("__best"))).drop("__best")
    draws = tied.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    tie = rng.order_key(F.lit(seed), F.col("draw"), *[F.col(c) for c in item], F.to_json("__run"))
    return (
        draws.groupBy(*group, "draw")
        .agg(F.min_by(value, tie).alias(value))
        .groupBy(*keys, "draw")
        .agg(F.avg(value).alias(value))
    )


# Rows that a task sorts in its memory.
TASK_ROWS = 1_000_000


def tasks_for(df: DataFrame, n: int) -> int:
    """Tasks for n rows, as many as there are cores at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS))


# Draws that are columns of an aggregate; more of them are rows.
PLACE_DRAWS = 50


def best_in_place(
    df: DataFrame, keys: list[str], item: list[str], run: list[Column], value: str, k: int, scores: dict[str, Column], seed: str, n: int
) -> DataFrame:
    """A row per item with an array of (draw, value) for each score, null without a run.

    ``scores`` maps a score to the condition of the runs it counts. A run is shuffled
    once, whatever the number of scores and draws; its hashes are made where it shares
    a best score with another one. An item's runs meet in one task; ``n`` is the number
    of rows, or more.
    """
    group = list(dict.fromkeys([*keys, *item]))
    names = list(scores)
    rows = df.select(
        *group, F.col(value).alias("__value"), F.struct(*run).alias("__run"),
        *[F.struct(F.col(n).alias("s")).alias(f"__s{i}") for i, n in enumerate(names)],
        *[scores[n].alias(f"__in{i}") for i, n in enumerate(names)],
    ).repartition(tasks_for(df, n), *group)
    whole = W.partitionBy(*group)
    some = range(len(names))
    rows = rows.withColumns({f"__best{i}": F.max(F.when(F.col(f"__in{i}"), F.col(f"__s{i}"))).over(whole) for i in some})
    rows = rows.withColumns({f"__tied{i}": F.coalesce(F.col(f"__in{i}"), F.lit(False)) & F.col(f"__s{i}").eqNullSafe(F.col(f"__best{i}")) for i in some})
    rows = rows.withColumns({f"__n{i}": F.count_if(f"__tied{i}").over(whole) for i in some})
    shared = F.lit(False)
    for i in some:
        shared = shared | (F.col(f"__tied{i}") & (F.col(f"__n{i}") > 1))
    text = F.to_json("__run")
    hashes = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda d: rng.order_key(F.lit(seed), d, *[F.col(c) for c in item], text),
    )
    rows = rows.withColumn("__ties", F.when(shared, hashes))

    def first(i: int, d: int) -> Column:
        tie = F.when(F.col(f"__n{i}") > 1, F.get("__ties", F.lit(d))).otherwise("")
        return F.struct(F.lit(d).alias("draw"), F.min_by("__value", F.when(F.col(f"__tied{i}"), tie)).alias("value"))

    found = [
        F.when(F.max(f"__n{i}") > 0, F.array(*[first(i, d) for d in range(k)])).alias(n) for i, n in enumerate(names)
    ]
    return rows.groupBy(*group).agg(*found)


def upsample(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Repeat the rows of smaller groups in turn until all are as large as the largest.

    Row r of a group of n rows appears once for every r + i * n below the largest
    size, so a row's copies follow from its place alone.
    """
    placed = ordering.running_total(df, [group], order, name="__r", total="__n")
    largest = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"))
    sized = placed.withColumn("__max", largest.scalar())
    copies = F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("__max") - 1 - F.col("__r")) / F.col("__n"))
    )
    return (
        sized.withColumn("__i", F.explode(copies))
        .withColumn("position", F.col("__i") * F.col("__n") + F.col("__r"))
        .drop("__r", "__n", "__max", "__i")
    )


def growing_subsets(
    df: DataFrame, item: str, value: str, sizes: list[int], seed: str = "0"
) -> DataFrame:
    """Item means within the first n items of one random order, for each n: (size, item, value)."""
    means = df.groupBy(item).agg(F.avg(value).alias(value))
    order = [rng.order_key(F.lit(seed), F.col(item)), F.col(item)]
    placed = ordering.running_total(means, [], order, name="__r")
    fits = F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: F.col("__r") < n)
    return placed.select(F.explode(fits).alias("size"), item, value)


def better_share(rank: Column, runs: Column, n: Column) -> Column:
    """Probability that all of n runs drawn without replacement are among those that
    ``rank`` runs are better than: ``C(runs - rank, n) / C(runs, n)``."""
    return F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), n - 1),
        F.lit(1.0),
        lambda acc, j: acc * F.greatest(F.lit(0).cast("bigint"), runs - rank - j).cast("double") / (runs - j).cast("double"),
    )


def best_of_n_by_rank(
    df: DataFrame,
    keys: list[str],
    item: list[str],
    tie: list[Column],
    value: str,
    n_samples: int,
    k: int,
    score: str = "score",
    seed: str = "0",
    bound: DataFrame | None = None,
) -> DataFrame:
    """The draws of ``best_of_n`` by the rank of the best run: (keys, draw, value, n_samples).

    One uniform number per item and draw is turned into the rank of the best of
    ``n_samples`` runs drawn without replacement, by the inverse of that rank's
    distribution. A run finds from its own rank in which draws it is the best, so no row
    is multiplied before it is averaged. Ties of the score have the order of ``tie``.
    Items with fewer runs give their best one. ``bound`` is explained at
    ``ordering.large_groups``.
    """
    rows = df.select(*dict.fromkeys([*keys, *item]), value, score, *tie)
    placed = ordering.running_total(rows, item, [-F.col(score), *tie], name="__r", total="__n", bound=bound)
    n = F.least(F.lit(n_samples).cast("bigint"), F.col("__n"))
    # Ranks beyond this are never the best of n.
    possible = placed.where(F.col("__r") <= F.col("__n") - n)
    ends = possible.withColumns(
        {
            "__high": better_share(F.col("__r"), F.col("__n"), n),
            "__low": better_share(F.col("__r") + 1, F.col("__n"), n),
            "__key": rng.key_text(F.lit(seed), *[F.col(c) for c in item]),
        }
    )

    def best_in(draw: Column) -> Column:
        u = rng.uniform(F.col("__key"), draw)
        return (u >= F.col("__low")) & (u < F.col("__high"))

    every = F.sequence(F.lit(0), F.lit(k - 1))
    # A run that is always the best one needs no hash.
    draws = F.when((F.col("__low") <= 0) & (F.col("__high") >= 1), every).otherwise(F.filter(every, best_in))
    best = ends.select(*keys, value, F.explode(draws).alias("draw"))
    return best.groupBy(*keys, "draw").agg(F.avg(value).alias(value)).withColumn("n_samples", F.lit(n_samples))


def draw_intervals(draws: DataFrame, keys: list[str], value: str, confidence: float = CONFIDENCE) -> DataFrame:
    """Mean of each group's draws with the interval that holds ``confidence`` of them."""
    alpha = (1 - confidence) / 2
    ends = F.percentile(value, F.array(F.lit(alpha), F.lit(1 - alpha)))
    found = draws.groupBy(*keys).agg(ends.alias("__q"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n_draws"))
    return found.select(*keys, F.col("__q")[0].alias("low"), "mean", F.col("__q")[1].alias("high"), "n_draws")


# Means from which a Poisson count follows from the normal quantile; below, the
# probabilities are added up, of which those beyond SMALL_TERMS are below 1e-16.
SMALL_MEAN = 10
SMALL_TERMS = 50


def poisson_of(mean: Column, u: Column) -> Column:
    """Poisson count of a uniform number for any mean.

    Small means are inverted exactly; for others the quantile is expanded around the
    normal one, which is off by 1 at most where it is off.
    """
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("upto"), F.lit(0.0).alias("w"))

    def step(acc: Column, j: Column) -> Column:
        p = acc["p"] * mean / (j + 1)
        return F.struct(p.alias("p"), (acc["upto"] + p).alias("upto"), (acc["w"] + F.when(u >= acc["upto"], 1.0).otherwise(0.0)).alias("w"))

    exact = F.aggregate(F.sequence(F.lit(0), F.lit(SMALL_TERMS)), start, step)["w"]
    z = normal.quantile(F.greatest(F.least(u, F.lit(1 - 2.0**-33)), F.lit(2.0**-33)))
    expanded = F.greatest(F.lit(0.0), F.round(mean + z * F.sqrt(mean) + (z * z - 1) / 6))
    return F.when(mean < SMALL_MEAN, exact).otherwise(expanded)


def counted_bootstrap(
    df: DataFrame,
    keys: list[str],
    value: str,
    n_resamples: int = N_RESAMPLES,
    method: str = "percentile",
    confidence: float = CONFIDENCE,
    seed: str = "0",
) -> DataFrame:
    """``bootstrap_mean`` for whole numbers that repeat: (keys, low, mean, high,
    confidence_level, n_samples).

    Equal values of a group become one row, which takes part in a replicate as often as a
    Poisson count with their number as mean. So draws are made for distinct values, not
    rows. ``method`` is ``percentile`` or ``basic``. Null values are left out.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("bigint").alias("__x"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    drawn = counts.withColumn("__replicate", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))))
    u = rng.uniform(F.lit(seed), *[F.col(c) for c in keys], F.col("__x"), F.col("__replicate"))
    weighted = drawn.withColumn("__w", poisson_of(F.col("__n").cast("double"), u))
    means = (
        weighted.groupBy(*keys, "__replicate")
        .agg((F.sum(F.col("__w") * F.col("__x")) / F.nullif(F.sum("__w"), F.lit(0.0))).alias("m"))
        .where(F.col("m").isNotNull())
    )
    alpha = (1 - confidence) / 2
    ends = F.percentile("m", F.array(F.lit(alpha), F.lit(1 - alpha)))
    stats = counts.groupBy(*keys).agg(
        (F.sum(F.col("__n") * F.col("__x")) / F.sum("__n")).alias("mean"), F.sum("__n").alias("n_samples")
    )
    both = join_on(stats, means.groupBy(*keys).agg(ends.alias("__q")), keys)
    low, high = F.col("__q")[0], F.col("__q")[1]
    if method == "basic":
        low, high = 2 * F.col("mean") - high, 2 * F.col("mean") - low
    return both.select(*keys, low.alias("low"), "mean", high.alias("high"), F.lit(confidence).alias("confidence_level"), "n_samples")


def growing_means(
    df: DataFrame,
    item: str,
    value: str,
    sizes: list[int],
    n_resamples: int = N_RESAMPLES,
    confidence: float = CONFIDENCE,
    seed: str = "0",
) -> DataFrame:
    """Mean over the first n items of one random order with a bootstrap interval, for each
    n: (size, low, mean, high, n_samples).

    An item is counted once, in the range of ranks between two sizes that it is in. The
    replicate sums of these ranges, added up from the first one on, are those of all
    sizes. Sizes beyond the number of items take all of them.
    """
    ordered = sorted(set(sizes))
    means = df.groupBy(item).agg(F.avg(value).alias(value)).where(F.col(value).isNotNull())
    order = [rng.order_key(F.lit(seed), F.col(item)), F.col(item)]
    placed = ordering.running_total(means, [], order, name="__r").where(F.col("__r") < ordered[-1])
    part = F.size(F.filter(F.array(*[F.lit(n) for n in ordered]), lambda n: F.col("__r") >= n))
    ranged = placed.withColumn("__part", part)
    later = F.explode(F.slice(F.array(*[F.lit(n) for n in ordered]), F.col("__part") + 1, len(ordered)))
    # A row per range and replicate from here on.
    sums = replicate_sums(ranged, ["__part"], value, [F.col(item)], n_resamples, seed)
    grown = sums.select("replicate", "w", "wx", later.alias("size")).groupBy("replicate", "size").agg(F.sum("w").alias("w"), F.sum("wx").alias("wx"))
    replicates = grown.where(F.col("w") > 0).withColumn("m", F.col("wx") / F.col("w"))
    totals = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("x"))
    stats = totals.select("n", "x", later.alias("size")).groupBy("size").agg((F.sum("x") / F.sum("n")).alias("mean"), F.sum("n").alias("n_samples"))
    alpha = (1 - confidence) / 2
    ends = F.percentile("m", F.array(F.lit(alpha), F.lit(1 - alpha)))
    return stats.join(replicates.groupBy("size").agg(ends.alias("__q")), "size").select(
        "size", F.col("__q")[0].alias("low"), "mean", F.col("__q")[1].alias("high"), "n_samples"
    )

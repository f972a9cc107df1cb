"""Windows, subsets, draws and bootstrap intervals over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dissensus.functions import normal, rng
from dissensus.operators import agreement, distributions, evaluation, ordering, resample, selection
from workloads import columns, reductions  # noqa: F401  (their views are used)
from workloads.base import query, r6, rounded

ITEM = ["dataset", "split", "dataset_idx"]
KEY = ["dataset", "split", "rid"]


def poisson_sql(u: str) -> str:
    """Poisson(1) count of a uniform number, as the Spark form has it."""
    return " + ".join(f"({u} >= {limit!r}::DOUBLE)::INT" for limit in rng.poisson_thresholds())


def uniform_sql(digest: str, word: str = "0") -> str:
    return f"(('0x' || substr({digest}, {word} * 8 + 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


# --- windows ------------------------------------------------------------------------

@query(
    "event_positions", "W1",
    "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run_idx FROM events",
)
def _(t):
    df = t.events.select("event_id", "user_id", "ts")
    return ordering.ranked(df, ["user_id"], [F.col("ts"), F.col("event_id")], "run_idx").drop("ts")


@query(
    "score_ranks", "W2",
    "SELECT dataset, split, rid, row_number() OVER (PARTITION BY dataset, split, dataset_idx ORDER BY d, run_idx, rid) AS d_rank FROM answers",
)
def _(t):
    df = selection.group_ranks(t.answers, ITEM, "d", [F.col("run_idx"), F.col("rid")])
    return df.select(*KEY, "d_rank")


@query(
    "loss_by_score_rank", "A47 W2",
    """WITH r AS (SELECT ws_loss, score, row_number() OVER (PARTITION BY dataset, split, dataset_idx ORDER BY score, run_idx, rid) AS score_rank FROM scored)
       SELECT score_rank, round(avg(score), 4) AS score, round(avg(ws_loss), 6) AS ws_loss FROM r GROUP BY ALL""",
)
def _(t):
    ranked = selection.group_ranks(t.scored, ITEM, "score", [F.col("run_idx"), F.col("rid")], bound=t.answers)
    out = selection.mean_by_rank(ranked, "score_rank", ["score", "ws_loss"])
    return out.select("score_rank", r6("score", 4).alias("score"), r6("ws_loss").alias("ws_loss"))


@query(
    "first_answers", "W6 S26",
    """SELECT dataset, split, dataset_idx, rid FROM (
         SELECT *, row_number() OVER (PARTITION BY dataset, split, dataset_idx ORDER BY run_idx, rid) AS rn FROM answers) WHERE rn = 1""",
)
def _(t):
    return ordering.first_rows(t.answers, ITEM, [F.col("run_idx"), F.col("rid")]).select(*ITEM, "rid")


@query(
    "last_event_values", "W7",
    "SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL",
)
def _(t):
    df = t.events.withColumn("at", F.struct("ts", "event_id"))
    return selection.last_value(df, ["user_id"], "value", "at")


@query(
    "best_and_worst_answers", "W8",
    """SELECT dataset, split, rid, CASE WHEN lo = 1 THEN 'worst' WHEN hi = 1 THEN 'best' ELSE 'in-between' END AS rating FROM (
         SELECT *, row_number() OVER (PARTITION BY dataset, split, dataset_idx ORDER BY score, run_idx, rid) AS lo,
                row_number() OVER (PARTITION BY dataset, split, dataset_idx ORDER BY score DESC, run_idx, rid) AS hi FROM answers)""",
)
def _(t):
    return selection.extremes(t.answers, ITEM, "score", [F.col("run_idx"), F.col("rid")]).select(*KEY, "rating")


@query(
    "distinct_answers", "M3 W6",
    """SELECT dataset, split, dataset_idx, run_idx, rid FROM (
         SELECT *, row_number() OVER (PARTITION BY dataset, split, dataset_idx, run_idx ORDER BY ts, rid) AS rn FROM answers) WHERE rn = 1""",
)
def _(t):
    from dissensus.operators import cleaning

    order = [F.col("ts"), F.col("rid")]
    return cleaning.distinct_answers(t.answers, order=order).select(*ITEM, "run_idx", "rid")


# --- subsets ------------------------------------------------------------------------

@query(
    "random_runs_per_item", "W5",
    """SELECT dataset, split, dataset_idx, rid FROM (
         SELECT *, row_number() OVER (PARTITION BY dataset, split, dataset_idx ORDER BY md5('0|' || rid), rid) AS rn FROM answers) WHERE rn <= 2""",
)
def _(t):
    return selection.random_rows(t.answers, ITEM, [F.col("rid")], 2).select(*ITEM, "rid")


@query(
    "distinct_items", "M2",
    "SELECT DISTINCT dataset, split, dataset_idx, model_id FROM answers",
)
def _(t):
    return t.answers.select(*ITEM, "model_id").dropDuplicates()


@query(
    "top_improvements", "M4",
    """SELECT s.dataset, s.split, s.dataset_idx, round(avg(s.ws_loss) - max(a.ws_loss), 6) AS improvement
       FROM scored s JOIN averaged_scored a USING (dataset, split, dataset_idx) GROUP BY ALL ORDER BY improvement DESC, dataset_idx, dataset, split LIMIT 25""",
)
def _(t):
    means = t.scored.groupBy(*ITEM).agg(F.avg("ws_loss").alias("mean"))
    average = t.averaged_scored.select(*ITEM, "ws_loss")
    joined = means.join(average, ITEM).select(*ITEM, r6(F.col("mean") - F.col("ws_loss")).alias("improvement"))
    return selection.top(joined, [F.desc("improvement"), "dataset_idx", "dataset", "split"], 25)


@query(
    "random_item_subset", "M5",
    "SELECT dataset_idx FROM (SELECT DISTINCT dataset_idx FROM answers) ORDER BY md5('0|' || dataset_idx), dataset_idx LIMIT 100",
)
def _(t):
    return selection.random_items(t.answers, 100)


@query(
    "random_items_by_dataset", "M11 J13",
    """SELECT dataset, split, rid FROM answers WHERE (dataset, dataset_idx) IN (
         SELECT (dataset, dataset_idx) FROM (
           SELECT dataset, dataset_idx, row_number() OVER (PARTITION BY dataset ORDER BY md5('0|' || dataset_idx), dataset_idx) AS rn
           FROM (SELECT DISTINCT dataset, dataset_idx FROM answers)) WHERE rn <= 50)""",
)
def _(t):
    ids = selection.random_items_by_dataset(t.answers, 50)
    return selection.only_items(t.answers, ids).select(*KEY)


@query(
    "shuffled_items", "M12",
    """SELECT o_orderkey, row_number() OVER (ORDER BY md5('0|' || o_orderkey), o_orderkey) - 1 AS place FROM orders""",
)
def _(t):
    df = t.orders.select("o_orderkey")
    order = [rng.order_key("0", F.col("o_orderkey")), F.col("o_orderkey")]
    return ordering.running_total(df, [], order, name="place")


@query(
    "shuffled_orders", "M12",
    "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5('0|' || o_orderkey), o_orderkey",
)
def _(t):
    return selection.shuffled(t.orders.select("o_orderkey", "o_orderstatus"), [F.col("o_orderkey")])


# --- draws --------------------------------------------------------------------------

@query(
    "simple_sampling_draws", "M6",
    f"""WITH r AS (SELECT dataset, split, dataset_idx, ws_loss,
           row_number() OVER (PARTITION BY dataset, split, dataset_idx ORDER BY md5('0|' || dataset || '|' || split || '|' || dataset_idx || '|' || rid), rid) - 1 AS r,
           count(*) OVER (PARTITION BY dataset, split, dataset_idx) AS n FROM scored),
     d AS (SELECT dataset, ws_loss, k.k AS draw, r, n, md5('0|' || dataset || '|' || split || '|' || dataset_idx || '|' || k.k) AS h FROM r, range(20) k(k))
     SELECT dataset, draw, round(avg(ws_loss), 6) AS ws_loss FROM d WHERE floor({uniform_sql('h')} * n) = r GROUP BY ALL""",
)
def _(t):
    return rounded(
        resample.simple_sampling(t.scored, ["dataset"], ITEM, [F.col("rid")], "ws_loss", k=20, bound=t.answers)
    )


@query(
    "best_of_n_draws", "M8",
    """WITH o AS (SELECT dataset, split, dataset_idx, ws_loss, score, k.k AS draw, rid,
             md5('0|draw_key|' || k.k || '|' || dataset || '|' || split || '|' || dataset_idx || '|' || '{"rid":"' || rid || '"}') AS o FROM scored, range(5) k(k)),
     t AS (SELECT *, row_number() OVER (PARTITION BY dataset, split, dataset_idx, draw ORDER BY o, rid) AS rn FROM o),
     b AS (SELECT dataset, draw, ws_loss, row_number() OVER (PARTITION BY dataset, split, dataset_idx, draw ORDER BY score DESC, o) AS r FROM t WHERE rn <= 2)
     SELECT dataset, draw, 2 AS n_samples, round(avg(ws_loss), 6) AS ws_loss FROM b WHERE r = 1 GROUP BY ALL""",
)
def _(t):
    draws = resample.best_of_n(
        t.scored, ITEM, [F.col("rid")], "ws_loss", n_samples=2, k=5, keys=["dataset"], bound=t.answers
    )
    return rounded(draws)


@query(
    "best_of_n_by_rank", "M8",
    f"""WITH r AS (SELECT dataset, split, dataset_idx, ws_loss, row_number() OVER (PARTITION BY dataset, split, dataset_idx ORDER BY score DESC, rid) - 1 AS r,
                         count(*) OVER (PARTITION BY dataset, split, dataset_idx) AS n FROM scored),
     s AS (SELECT *, CASE WHEN n = 1 THEN (n - r)::DOUBLE / n ELSE (n - r)::DOUBLE / n * greatest(0, n - r - 1)::DOUBLE / (n - 1) END AS high,
                  CASE WHEN n = 1 THEN (n - r - 1)::DOUBLE / n ELSE (n - r - 1)::DOUBLE / n * greatest(0, n - r - 2)::DOUBLE / (n - 1) END AS low FROM r),
     d AS (SELECT dataset, ws_loss, k.k AS draw, high, low, {uniform_sql("md5('0|' || dataset || '|' || split || '|' || dataset_idx || '|' || k.k)")} AS u FROM s, range(20) k(k))
     SELECT dataset, draw::INTEGER AS draw, 2 AS n_samples, round(avg(ws_loss), 6) AS ws_loss FROM d WHERE u >= low AND u < high GROUP BY ALL""",
)
def _(t):
    draws = resample.best_of_n_by_rank(t.scored, ["dataset"], ITEM, [F.col("rid")], "ws_loss", n_samples=2, k=20, bound=t.answers)
    return rounded(draws)


@query(
    "simple_sampling_intervals", "M6",
    f"""WITH r AS (SELECT dataset, split, dataset_idx, ws_loss,
           row_number() OVER (PARTITION BY dataset, split, dataset_idx ORDER BY md5('0|' || dataset || '|' || split || '|' || dataset_idx || '|' || rid), rid) - 1 AS r,
           count(*) OVER (PARTITION BY dataset, split, dataset_idx) AS n FROM scored),
     d AS (SELECT dataset, ws_loss, k.k AS draw, r, n, md5('0|' || dataset || '|' || split || '|' || dataset_idx || '|' || k.k) AS h FROM r, range(20) k(k)),
     m AS (SELECT dataset, draw, avg(ws_loss) AS m FROM d WHERE floor({uniform_sql('h')} * n) = r GROUP BY ALL)
     SELECT dataset, round(quantile_cont(m, 0.025), 5) AS low, round(avg(m), 5) AS mean, round(quantile_cont(m, 0.975), 5) AS high, count(*) AS n_draws FROM m GROUP BY ALL""",
)
def _(t):
    draws = resample.simple_sampling(t.scored, ["dataset"], ITEM, [F.col("rid")], "ws_loss", k=20, bound=t.answers)
    return rounded(resample.draw_intervals(draws, ["dataset"], "ws_loss"), 5)


@query(
    "expected_best_of_n", "M9",
    """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY CAST(props ->> 'k' AS INT) DESC, event_id) AS r,
                         count(*) OVER (PARTITION BY user_id) AS n FROM events),
     s AS (SELECT *, k.k AS n_samples, least(k.k, n) AS m FROM r, (SELECT unnest([1, 2, 3, 5]) AS k) k),
     p AS (SELECT n_samples, value, CASE m WHEN 1 THEN 1.0::DOUBLE / n
             WHEN 2 THEN 2.0::DOUBLE / n * (n - r) / (n - 1)
             WHEN 3 THEN 3.0::DOUBLE / n * (n - r) / (n - 1) * (n - r - 1) / (n - 2)
             ELSE 5.0::DOUBLE / n * (n - r) / (n - 1) * (n - r - 1) / (n - 2) * (n - r - 2) / (n - 3) * (n - r - 3) / (n - 4) END AS w FROM s)
     SELECT n_samples, round(sum(w * value) / (SELECT count(DISTINCT user_id) FROM events), 5) AS value FROM p GROUP BY ALL""",
)
def _(t):
    from dissensus.functions import text

    df = t.events.select("user_id", "value", "event_id", text.parse(F.col("props"), "k int")["k"].alias("score"))
    out = resample.expected_best_of_n(df, ["user_id"], [F.col("event_id")], "value", [1, 2, 3, 5])
    return rounded(out, 5)


@query(
    "bootstrap_basic", "M7 A46",
    f"""WITH v AS (SELECT o_orderpriority AS p, o_totalprice AS x, '0|' || o_orderkey AS key FROM orders),
     d AS (SELECT p, x, b.b * 4 + w.w AS replicate, {uniform_sql("md5(key || '|' || b.b)", "w.w")} AS u FROM v, range(50) b(b), range(4) w(w)),
     s AS (SELECT p, replicate, sum(x * ({poisson_sql('u')})) / sum({poisson_sql('u')}) AS m FROM d GROUP BY ALL),
     q AS (SELECT p, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM s GROUP BY ALL),
     g AS (SELECT p, avg(x) AS mean, count(*) AS n FROM v GROUP BY ALL)
     SELECT p AS o_orderpriority, round(2 * mean - hi, 3) AS low, round(mean, 3) AS mean, round(2 * mean - lo, 3) AS high, 0.95::DOUBLE AS confidence_level, n AS n_samples
     FROM g JOIN q USING (p)""",
)
def _(t):
    return rounded(
        resample.bootstrap_mean(
            t.orders, ["o_orderpriority"], "o_totalprice", [F.col("o_orderkey")], n_resamples=200, method="basic"
        ),
        3,
    )


@query(
    "bootstrap_percentile", "M7",
    f"""WITH v AS (SELECT event_type AS p, value AS x, '7|' || event_id AS key FROM events),
     d AS (SELECT p, x, b.b * 4 + w.w AS replicate, {uniform_sql("md5(key || '|' || b.b)", "w.w")} AS u FROM v, range(100) b(b), range(4) w(w)),
     s AS (SELECT p, replicate, sum(x * ({poisson_sql('u')})) / sum({poisson_sql('u')}) AS m FROM d GROUP BY ALL),
     q AS (SELECT p, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM s GROUP BY ALL),
     g AS (SELECT p, avg(x) AS mean, count(*) AS n FROM v GROUP BY ALL)
     SELECT p AS event_type, round(lo, 5) AS low, round(mean, 5) AS mean, round(hi, 5) AS high, 0.95::DOUBLE AS confidence_level, n AS n_samples
     FROM g JOIN q USING (p)""",
)
def _(t):
    return rounded(
        resample.bootstrap_mean(
            t.events, ["event_type"], "value", [F.col("event_id")], n_resamples=400, method="percentile", seed="7"
        ),
        5,
    )


def normal_quantile_sql(p: str) -> str:
    """The inverse normal distribution as the Spark form has it."""
    def poly(x: str, coefficients) -> str:
        out = repr(coefficients[0]) + "::DOUBLE"
        for c in coefficients[1:]:
            out = f"({out} * {x} + {c!r}::DOUBLE)"
        return out

    r, s = f"(({p}) - 0.5) * (({p}) - 0.5)", lambda q: f"sqrt(ln({q}) * -2)"
    end = lambda q: f"{poly(s(q), normal.ENDS_UP)} / {poly(s(q), normal.ENDS_DOWN)}"
    return (
        f"CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN NULL WHEN ({p}) < {normal.ENDS} THEN {end(p)} "
        f"WHEN ({p}) > 1 - {normal.ENDS} THEN -({end(f'1 - ({p})')}) "
        f"ELSE {poly(r, normal.MIDDLE_UP)} * (({p}) - 0.5) / {poly(r, normal.MIDDLE_DOWN)} END"
    )


def normal_cdf_sql(x: str) -> str:
    t = f"(1 / (abs({x}) * {normal.TAIL_SCALE} + 1))"
    poly = "0.0::DOUBLE"
    for c in reversed(normal.TAIL):
        poly = f"({poly} * {t} + {c!r}::DOUBLE)"
    tail = f"exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {poly} * {t}"
    return f"CASE WHEN ({x}) >= 0 THEN 1 - {tail} ELSE {tail} END"


def bca_sql(source: str, group: str, value: str, key: str, blocks: int, digits: int) -> str:
    """Accelerated intervals of the means of a table's groups."""
    low, high = (normal_quantile_sql(f"{q}::DOUBLE") for q in (0.025, 0.975))
    moved = lambda z: f"bias + (bias + {z}) / (1 - a * (bias + {z}))"
    at = lambda i: f"ms[floor(p{i})::INT + 1] + (ms[ceil(p{i})::INT + 1] - ms[floor(p{i})::INT + 1]) * (p{i} - floor(p{i}))"
    return f"""WITH v AS (SELECT {group} AS p, {value} AS x, '0|' || {key} AS key FROM {source} WHERE {value} IS NOT NULL),
     d AS (SELECT p, x, b.b * 4 + w.w AS replicate, {uniform_sql("md5(key || '|' || b.b)", "w.w")} AS u FROM v, range({blocks}) b(b), range(4) w(w)),
     s AS (SELECT p, replicate, sum(x * ({poisson_sql('u')})) / sum({poisson_sql('u')}) AS m FROM d GROUP BY ALL),
     l AS (SELECT p, list_sort(list(m)) AS ms FROM s WHERE m IS NOT NULL GROUP BY p),
     m AS (SELECT p, avg(x) AS mean, count(*) AS n FROM v GROUP BY p),
     k AS (SELECT p, mean, n, CASE WHEN avg((x - mean) ** 2) > 0 THEN avg((x - mean) ** 3) / avg((x - mean) ** 2) ** 1.5 ELSE 0 END / (6 * sqrt(n)) AS a
           FROM v JOIN m USING (p) GROUP BY p, mean, n),
     q AS (SELECT *, (len(list_filter(ms, lambda e: e < mean)) + len(list_filter(ms, lambda e: e <= mean))) / (2.0::DOUBLE * len(ms)) AS share FROM k JOIN l USING (p)),
     z AS (SELECT *, {normal_quantile_sql("share")} AS bias FROM q),
     e AS (SELECT *, {moved(f"({low})")} AS z0, {moved(f"({high})")} AS z1 FROM z),
     f AS (SELECT *, ({normal_cdf_sql("z0")}) * (len(ms) - 1) AS p0, ({normal_cdf_sql("z1")}) * (len(ms) - 1) AS p1 FROM e)
     SELECT p AS {group}, round({at(0)}, {digits}) AS low, round(mean, {digits}) AS mean, round({at(1)}, {digits}) AS high,
            0.95::DOUBLE AS confidence_level, n AS n_samples FROM f"""


@query("bootstrap_bca", "M7 A46", bca_sql("events", "event_type", "value", "event_id", 100, 5))
def _(t):
    return rounded(resample.bootstrap_mean(t.events, ["event_type"], "value", [F.col("event_id")], n_resamples=400), 5)


@query("loss_intervals", "M7", bca_sql("scored", "dataset", "ws_loss", "rid", 25, 4))
def _(t):
    scored = t.scored.select("dataset", "rid", "ws_loss")
    return rounded(resample.bootstrap_mean(scored, ["dataset"], "ws_loss", [F.col("rid")], n_resamples=100), 4)


@query("rater_score_intervals", "M7", bca_sql("lineitem", "l_returnflag", "l_discount", "(l_orderkey || '|' || l_linenumber)", 25, 6))
def _(t):
    row = [F.col("l_orderkey"), F.col("l_linenumber")]
    return rounded(resample.bootstrap_mean(t.lineitem, ["l_returnflag"], "l_discount", row, n_resamples=100), 6)


@query(
    "cautious_means", "A46",
    f"""WITH v AS (SELECT c_mktsegment AS p, c_acctbal AS x, '0|' || c_custkey AS key FROM customer),
     g AS (SELECT p, avg(x) AS mean, count(*) AS n FROM v GROUP BY ALL),
     d AS (SELECT p, x, b.b * 4 + w.w AS replicate, {uniform_sql("md5(key || '|' || b.b)", "w.w")} AS u FROM v, range(50) b(b), range(4) w(w)),
     s AS (SELECT p, replicate, sum(x * ({poisson_sql('u')})) / sum({poisson_sql('u')}) AS m FROM d GROUP BY ALL),
     q AS (SELECT p, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM s GROUP BY ALL)
     SELECT p AS c_mktsegment, round(2 * mean - hi, 4) AS low, round(mean, 4) AS mean, round(2 * mean - lo, 4) AS high, 0.95::DOUBLE AS confidence_level, n AS n_samples
     FROM g JOIN q USING (p)""",
)
def _(t):
    return rounded(
        resample.cautious_mean(t.customer, ["c_mktsegment"], "c_acctbal", [F.col("c_custkey")], n_resamples=200), 4
    )


@query(
    "upsampled_groups", "M10",
    """WITH g AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS r,
                         count(*) OVER (PARTITION BY event_type) AS n FROM events),
     m AS (SELECT max(n) AS m FROM g)
     SELECT event_type, event_id, i.i * n + r AS position FROM g, m, range(2) i(i) WHERE i.i * n + r < m""",
)
def _(t):
    df = t.events.select("event_type", "event_id")
    return resample.upsample(df, "event_type", [F.col("event_id")])


@query(
    "random_labels", "M13",
    f"""SELECT dataset, split, rid, pred FROM (SELECT dataset, split, rid,
              (lo + floor({uniform_sql("md5('0|' || dataset || '|' || split || '|' || dataset_idx || '|' || rid)")} * (hi - lo + 1)))::INTEGER AS pred FROM (
           SELECT *, CASE dataset WHEN 'CSC' THEN 1 WHEN 'MP' THEN 0 ELSE -5 END AS lo, CASE dataset WHEN 'CSC' THEN 6 WHEN 'MP' THEN 1 ELSE 5 END AS hi FROM answers))""",
)
def _(t):
    df = t.answers.select(*ITEM, "rid", F.col("rid").alias("annotator_id"))
    return distributions.random_labels(df).select(*KEY, "pred")


@query(
    "random_label_distance", "M13",
    f"""SELECT dataset, split, dataset_idx, round(avg(abs((lo + floor({uniform_sql("md5('0|' || dataset || '|' || split || '|' || dataset_idx || '|' || rid)")} * (hi - lo + 1))) - target) / (n_classes - 1)), 6) AS avg_abs_dist FROM (
           SELECT *, CASE dataset WHEN 'CSC' THEN 1 WHEN 'MP' THEN 0 ELSE -5 END AS lo, CASE dataset WHEN 'CSC' THEN 6 WHEN 'MP' THEN 1 ELSE 5 END AS hi FROM labelled)
       GROUP BY ALL""",
)
def _(t):
    df = t.labelled.select(*ITEM, F.col("rid").alias("annotator_id"), "target")
    return rounded(distributions.random_label_distance(df))


@query(
    "best_with_random_ties", "M14",
    """WITH b AS (SELECT dataset, split, dataset_idx, ws_loss, rid, rank() OVER (PARTITION BY dataset, split, dataset_idx ORDER BY t DESC) AS rk
                  FROM scored JOIN (SELECT rid, t FROM answers) USING (rid)),
     d AS (SELECT *, row_number() OVER (PARTITION BY dataset, split, dataset_idx, k.k ORDER BY md5('0|' || k.k || '|' || dataset || '|' || split || '|' || dataset_idx || '|' || '{"rid":"' || rid || '"}')) AS rn,
                  k.k AS draw FROM b, range(10) k(k) WHERE rk = 1)
     SELECT dataset, draw, round(avg(ws_loss), 6) AS ws_loss FROM d WHERE rn = 1 GROUP BY ALL""",
)
def _(t):
    df = t.scored.join(t.answers.select("rid", F.col("t").alias("grade")), "rid")
    return rounded(
        resample.best_with_random_ties(df, ["dataset"], ITEM, [F.col("rid")], "ws_loss", 10, score="grade", bound=t.answers)
    )


@query(
    "means_of_growing_subsets", "M15",
    """WITH m AS (SELECT dataset_idx, avg(ws_loss) AS x FROM scored GROUP BY ALL),
     o AS (SELECT *, row_number() OVER (ORDER BY md5('0|' || dataset_idx), dataset_idx) AS r FROM m)
     SELECT s.s AS size, count(*) AS n, round(avg(x), 6) AS ws_loss FROM o, (SELECT unnest([100, 300, 500, 1000, 2000]) AS s) s WHERE r <= s.s GROUP BY ALL""",
)
def _(t):
    sized = resample.growing_subsets(t.scored, "dataset_idx", "ws_loss", [100, 300, 500, 1000, 2000])
    return rounded(sized.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.avg("ws_loss").alias("ws_loss")))


@query(
    "intervals_of_growing_subsets", "M15",
    f"""WITH m AS (SELECT dataset_idx, avg(ws_loss) AS x FROM scored GROUP BY ALL),
     o AS (SELECT *, row_number() OVER (ORDER BY md5('0|' || dataset_idx), dataset_idx) AS r FROM m),
     z AS (SELECT s.s AS size, dataset_idx, x FROM o, (SELECT unnest([100, 300, 1000]) AS s) s WHERE r <= s.s),
     u AS (SELECT size, x, b.b * 4 + w.w AS replicate, {uniform_sql("md5('0|' || dataset_idx || '|' || b.b)", "w.w")} AS u FROM z, range(25) b(b), range(4) w(w)),
     p AS (SELECT size, replicate, sum(x * ({poisson_sql('u')})) / sum({poisson_sql('u')}) AS m FROM u GROUP BY ALL),
     q AS (SELECT size, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM p GROUP BY ALL),
     g AS (SELECT size, avg(x) AS mean, count(*) AS n FROM z GROUP BY ALL)
     SELECT size, round(low, 5) AS low, round(mean, 5) AS mean, round(high, 5) AS high, n AS n_samples FROM g JOIN q USING (size)""",
)
def _(t):
    return rounded(resample.growing_means(t.scored, "dataset_idx", "ws_loss", [100, 300, 1000], n_resamples=100), 5)


@query(
    "loss_by_entropy_rank", "A47 W2",
    """WITH r AS (SELECT ws_loss, pred_entropy, row_number() OVER (PARTITION BY dataset, split, dataset_idx ORDER BY round(pred_entropy, 6), run_idx, rid) AS entropy_rank FROM scored)
       SELECT entropy_rank, round(avg(pred_entropy), 4) AS pred_entropy, round(avg(ws_loss), 5) AS ws_loss FROM r GROUP BY ALL""",
)
def _(t):
    # Rounded, so that entropies of equal shares in another order are ties.
    rows = t.scored.withColumn("entropy", r6("pred_entropy"))
    ranked = selection.group_ranks(rows, ITEM, "entropy", [F.col("run_idx"), F.col("rid")], bound=t.answers)
    out = selection.mean_by_rank(ranked, "entropy_rank", ["pred_entropy", "ws_loss"])
    return out.select("entropy_rank", r6("pred_entropy", 4).alias("pred_entropy"), r6("ws_loss", 5).alias("ws_loss"))


@query(
    "accuracy_intervals_by_nation", "A41 M7",
    f"""WITH v AS (SELECT nation, (pred = target)::INT AS x FROM labelled l JOIN annotators a ON l.annotator = a.suppkey),
     c AS (SELECT nation, x, count(*) AS n FROM v GROUP BY ALL),
     d AS (SELECT nation, x, n, k.k AS replicate, greatest(least({uniform_sql("md5(concat_ws('|', '0', nation, x, k.k))")}, 1 - 2.0::DOUBLE ** -33), 2.0::DOUBLE ** -33) AS u FROM c, range(200) k(k)),
     z AS (SELECT *, {normal_quantile_sql("u")} AS z FROM d),
     w AS (SELECT *, greatest(0, round(n + z * sqrt(n) + (z * z - 1) / 6)) AS w FROM z),
     m AS (SELECT nation, replicate, sum(w * x) / sum(w) AS m FROM w GROUP BY ALL HAVING sum(w) > 0),
     q AS (SELECT nation, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY ALL),
     g AS (SELECT nation, avg(x) AS mean, count(*) AS n FROM v GROUP BY ALL)
     SELECT g.nation, round(low, 6) AS low, round(mean, 6) AS mean, round(high, 6) AS high, 0.95::DOUBLE AS confidence_level, n AS n_samples FROM g JOIN q ON g.nation IS NOT DISTINCT FROM q.nation""",
)
def _(t):
    from dissensus.operators import joins

    rows = t.labelled.select(F.lit("all").alias("dataset"), F.col("annotator").cast("string").alias("annotator_id"), "pred", "target")
    return rounded(evaluation.accuracy_intervals(joins.with_metadata(rows, t.annotators), "nation", n_resamples=200))


@query(
    "correlation_interval", "A31 M7",
    f"""WITH c AS (SELECT part, coalesce(CASE WHEN stddev_pop(score) = 0 OR stddev_pop(d) = 0 THEN 0 ELSE corr(score, d) END, 0) AS x FROM answers GROUP BY ALL),
     d AS (SELECT x, b.b * 4 + w.w AS replicate, {uniform_sql("md5('0|' || part || '|' || b.b)", "w.w")} AS u FROM c, range(50) b(b), range(4) w(w)),
     s AS (SELECT replicate, sum(x * ({poisson_sql('u')})) / sum({poisson_sql('u')}) AS m FROM d GROUP BY ALL),
     q AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM s),
     g AS (SELECT avg(x) AS mean, count(*) AS n FROM c)
     SELECT round(2 * mean - hi, 5) AS low, round(mean, 5) AS mean, round(2 * mean - lo, 5) AS high, 0.95::DOUBLE AS confidence_level, n AS n_samples FROM g, q""",
)
def _(t):
    return rounded(agreement.group_correlation_interval(t.answers, ["part"], "score", "d", n_resamples=200, method="basic"), 5)


@query(
    "rating_configurations", "A43 P18 P19",
    """WITH c AS (SELECT rid, 'ok=0' AS mapping, ok0 AS g FROM judgements UNION ALL SELECT rid, 'ok=1', ok1 FROM judgements)
       SELECT rid, mapping, unnest(['mean', 'product', 'min']) AS operation, round(unnest([list_avg(g), list_product(g), list_min(g)]), 6) AS score
       FROM c WHERE g IS NOT NULL""",
)
def _(t):
    return rounded(evaluation.rating_configurations(t.judgements.select("rid", "response")))


@query(
    "rating_matrix", "A43 M14 M7",
    f"""WITH c AS (SELECT *, ok0 AS g, 'ok=0' AS mapping FROM judgements UNION ALL SELECT *, ok1 AS g, 'ok=1' AS mapping FROM judgements),
     s AS (SELECT split, dataset, dataset_idx, rid, (pred = target)::INT AS is_correct, mapping, unnest(['mean', 'product', 'min']) AS operation,
                  unnest([list_avg(g), list_product(g), list_min(g)]) AS score FROM c WHERE g IS NOT NULL),
     b AS (SELECT *, rank() OVER (PARTITION BY mapping, operation, dataset, split, dataset_idx ORDER BY score DESC) AS rk FROM s),
     d AS (SELECT mapping, operation, k.k AS draw, is_correct, row_number() OVER (PARTITION BY mapping, operation, dataset, split, dataset_idx, k.k
             ORDER BY md5('0|' || k.k || '|' || dataset || '|' || split || '|' || dataset_idx || '|' || '{{"rid":"' || rid || '"}}')) AS rn FROM b, range(10) k(k) WHERE rk = 1),
     v AS (SELECT mapping, operation, draw, avg(is_correct) AS x, '0|' || mapping || '|' || operation || '|' || draw AS key FROM d WHERE rn = 1 GROUP BY ALL),
     e AS (SELECT mapping, operation, x, b.b * 4 + w.w AS replicate, {uniform_sql("md5(key || '|' || b.b)", "w.w")} AS u FROM v, range(50) b(b), range(4) w(w)),
     p AS (SELECT mapping, operation, replicate, sum(x * ({poisson_sql('u')})) / sum({poisson_sql('u')}) AS m FROM e GROUP BY ALL HAVING sum({poisson_sql('u')}) > 0),
     q AS (SELECT mapping, operation, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM p GROUP BY ALL),
     g AS (SELECT mapping, operation, avg(x) AS mean, count(*) AS n FROM v GROUP BY ALL)
     SELECT mapping, operation, round(low, 5) AS low, round(mean, 5) AS mean, round(high, 5) AS high, 0.95::DOUBLE AS confidence_level, n AS n_samples FROM g JOIN q USING (mapping, operation)""",
)
def _(t):
    df = t.judgements.select(*ITEM, "rid", "response", (F.col("pred") == F.col("target")).cast("int").alias("is_correct"))
    return rounded(
        evaluation.rating_matrix(df, ITEM, ["rid"], draws=10, n_resamples=200, method="percentile", bound=t.answers), 5
    )

"""Reductions over repeated answers, baselines, votes and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from dissensus import registry
from dissensus.operators import (
    agreement,
    distributions,
    diversity,
    evaluation,
    joins,
    metrics,
    ordering,
    reshape,
    selection,
    votes,
)
from dissensus.plans import reports
from dissensus.session import written
from workloads import columns, joining  # noqa: F401  (their views are used)
from workloads.base import long_vector, query, rounded, view

ITEM = ["dataset", "split", "dataset_idx"]
KEY = ["dataset", "split", "rid"]


@query(
    "brand_shift", "P13 P28 A1 A5",
    """WITH s AS (SELECT l_partkey, k.k AS i,
         count(*) FILTER (l_linestatus = 'O' AND round(l_discount * 100) = k.k) / nullif(count(*) FILTER (l_linestatus = 'O'), 0)::DOUBLE AS o,
         count(*) FILTER (l_linestatus = 'F' AND round(l_discount * 100) = k.k) / nullif(count(*) FILTER (l_linestatus = 'F'), 0)::DOUBLE AS f
         FROM lineitem, range(11) k(k) GROUP BY ALL),
     c AS (SELECT *, sum(o - f) OVER (PARTITION BY l_partkey ORDER BY i) AS gap FROM s),
     p AS (SELECT l_partkey, sum(abs(gap)) AS ws, -sum(CASE WHEN o > 0 THEN o * ln(o) ELSE 0 END) AS h
           FROM c WHERE o IS NOT NULL AND f IS NOT NULL GROUP BY ALL)
     SELECT p_brand, count(*) AS parts, round(avg(ws), 6) AS ws_loss, round(avg(h), 6) AS open_entropy
     FROM p JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
)
def _(t):
    status = F.col("l_linestatus")
    index = F.round(F.col("l_discount") * 100).cast("int")
    sides = distributions.compared_shares(
        t.lineitem, ["l_partkey"], index, 11, {"pred": status == "O", "target": status == "F"}
    ).where(F.col("pred").isNotNull() & F.col("target").isNotNull())
    scored = metrics.with_soft_metrics(sides.withColumn("n_classes", F.lit(11)))
    brands = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return rounded(
        scored.join(brands, "l_partkey").groupBy("p_brand").agg(
            F.count(F.lit(1)).alias("parts"),
            F.avg("ws_loss").alias("ws_loss"),
            F.avg("pred_entropy").alias("open_entropy"),
        )
    )


@query(
    "item_label_shares", "A5 A17",
    """SELECT dataset, split, dataset_idx, k.k AS class_idx, round(count(*) FILTER (pred + off = k.k) / count(*)::DOUBLE, 6) AS prob
       FROM labelled, range(11) k(k) WHERE k.k < n_classes GROUP BY dataset, split, dataset_idx, k.k""",
)
def _(t):
    return long_vector(distributions.soft_labels(t.labelled), ITEM)


@query(
    "mean_metrics_by_setting", "A1 A37 W4",
    """SELECT model_id, dataset, split, template_id, round(avg(ws_loss), 6) AS ws_loss, round(avg(pred_entropy), 6) AS pred_entropy
       FROM scored GROUP BY ALL""",
)
def _(t):
    return rounded(metrics.mean_metrics(t.scored))


@query(
    "uniform_baseline_means", "A2 J15",
    """WITH g AS (SELECT *, sum(target - 1.0 / n_classes) OVER (PARTITION BY dataset, split, dataset_idx ORDER BY class_idx) AS gap FROM targets),
     w AS (SELECT dataset, split, dataset_idx, sum(abs(gap)) AS ws FROM g GROUP BY ALL)
     SELECT dataset, split, round(avg(ws), 6) AS ws_loss FROM w GROUP BY ALL""",
)
def _(t):
    return rounded(metrics.uniform_baseline_means(t.targets))


@query(
    "uniform_entropy", "A3",
    "SELECT DISTINCT dataset, round(ln(n_classes), 6) AS entropy FROM labelled",
)
def _(t):
    return rounded(metrics.uniform_entropy(t.answers))


@query(
    "mean_target_entropy", "A4",
    """SELECT dataset, n_classes, round(avg(h), 6) AS entropy FROM (
         SELECT dataset, n_classes, split, dataset_idx, -sum(CASE WHEN target > 0 THEN target * ln(target) ELSE 0 END) AS h FROM targets GROUP BY ALL)
       GROUP BY dataset, n_classes""",
)
def _(t):
    return rounded(metrics.mean_target_entropy(t.targets))


@view(
    "averaged",
    "SELECT dataset, split, dataset_idx, n_classes, class_idx, avg(p) AS p FROM soft GROUP BY ALL",
)
def averaged(t):
    return distributions.model_average(t.soft.select(*ITEM, "n_classes", "pred"))


@query(
    "model_average", "A6 A7",
    "SELECT dataset, split, dataset_idx, class_idx, round(p, 6) AS prob FROM averaged",
)
def _(t):
    return long_vector(t.averaged, ITEM)


@query(
    "weighted_model_average", "A6",
    """WITH w AS (SELECT dataset, split, dataset_idx, class_idx, sum(p * sqrt(q)) / sum(sqrt(q)) AS p FROM soft GROUP BY ALL)
       SELECT dataset, split, dataset_idx, class_idx, round(p, 6) AS prob FROM w""",
)
def _(t):
    df = t.soft.select(*ITEM, "q", "pred")
    return long_vector(distributions.mean_vectors(df, ITEM, weight=F.sqrt("q"), width=registry.MAX_CLASSES), ITEM)


@query(
    "mean_embedding_by_label", "A6 A7",
    """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS class FROM embeddings)
       SELECT label, class, round(avg(abs(x)), 6) AS v FROM e GROUP BY ALL""",
)
def _(t):
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    df = t.embeddings.select("label", v.alias("v"))
    out = distributions.mean_vectors_long(df, ["label"], "v")
    return rounded(out.withColumn("class", F.col("class").cast("bigint")))


@view(
    "averaged_scored",
    """SELECT dataset, split, dataset_idx, sum(abs(gap)) AS ws_loss, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS pred_entropy FROM (
         SELECT a.*, sum(a.p - g.target) OVER (PARTITION BY a.dataset, a.split, a.dataset_idx ORDER BY a.class_idx) AS gap
         FROM averaged a JOIN targets g USING (dataset, split, dataset_idx, class_idx)) GROUP BY ALL""",
)
def averaged_scored(t):
    preds = t.soft.select(*ITEM, "n_classes", "pred")
    return distributions.model_average_metrics(preds, t.targets)


@query(
    "model_average_metrics", "A8",
    "SELECT dataset, split, dataset_idx, round(ws_loss, 6) AS ws_loss, round(pred_entropy, 6) AS pred_entropy FROM averaged_scored",
)
def _(t):
    return rounded(t.averaged_scored.select(*ITEM, "ws_loss", "pred_entropy"))


@query(
    "smoothed_metrics", "A9 P25",
    """WITH c AS (SELECT *, sum((p + 1.0 / n_classes) / 2 - target) OVER (PARTITION BY dataset, split, rid ORDER BY class_idx) AS gap FROM pairs),
     w AS (SELECT dataset, split, rid, sum(abs(gap)) AS ws FROM c GROUP BY ALL)
     SELECT dataset, split, round(avg(ws), 6) AS ws_loss, count(*) AS n FROM w GROUP BY dataset, split""",
)
def _(t):
    preds = t.soft.select(*ITEM, "n_classes", "rid", "pred")
    scored = distributions.smoothed_metrics(preds, t.targets)
    return rounded(
        scored.groupBy("dataset", "split").agg(F.avg("ws_loss").alias("ws_loss"), F.count(F.lit(1)).alias("n"))
    )


@view(
    "best",
    """SELECT dataset, split, dataset_idx, rid, ws_loss FROM (
         SELECT *, row_number() OVER (PARTITION BY dataset, split, dataset_idx ORDER BY round(ws_loss, 9), run_idx, rid) AS rn FROM scored) WHERE rn = 1""",
)
def best(t):
    rows = t.scored.withColumn("ws", F.round("ws_loss", 9))
    return ordering.first_rows(rows, ITEM, [F.col("ws"), F.col("run_idx"), F.col("rid")]).drop("ws")


@query(
    "oracle_loss", "A10",
    """SELECT dataset, split, template_id, model_id, gen_kwargs, dataset_idx, round(min(ws_loss), 6) AS ws_loss FROM scored GROUP BY ALL""",
)
def _(t):
    keys = ["template_id", "model_id", "gen_kwargs", *ITEM]
    return rounded(selection.oracle(t.scored, "ws_loss", keys).select(*keys, "ws_loss"))


@query(
    "oracle_answers", "A10",
    "SELECT dataset, split, dataset_idx, rid FROM best",
)
def _(t):
    return t.best.select(*ITEM, "rid")


@query(
    "dataset_mean_vectors", "A11",
    "SELECT dataset, class_idx, round(avg(target), 6) AS prob FROM targets GROUP BY ALL",
)
def _(t):
    return long_vector(distributions.dataset_mean(t.targets), ["dataset"])


@query(
    "dataset_mean_losses", "A11",
    """WITH m AS (SELECT dataset, class_idx, avg(target) AS p FROM targets GROUP BY ALL),
     c AS (SELECT g.*, sum(m.p - g.target) OVER (PARTITION BY g.dataset, split, dataset_idx ORDER BY g.class_idx) AS gap
           FROM targets g JOIN m ON g.dataset = m.dataset AND g.class_idx = m.class_idx)
     SELECT dataset, split, dataset_idx, round(sum(abs(gap)), 6) AS ws_loss FROM c GROUP BY ALL""",
)
def _(t):
    return rounded(distributions.dataset_mean_metrics(t.targets).select(*ITEM, "ws_loss"))


@view(
    "frequent",
    """SELECT dataset, annotator, label FROM (
         SELECT *, row_number() OVER (PARTITION BY dataset, annotator ORDER BY n DESC, label::VARCHAR) AS rn
         FROM (SELECT dataset, annotator, pred AS label, count(*) AS n FROM labelled GROUP BY ALL)) WHERE rn = 1""",
)
def frequent(t):
    return votes.most_frequent_label(t.annotation_rows)


@view("annotation_rows", "SELECT * FROM labelled")
def annotation_rows(t):
    return t.labelled.select(
        *ITEM, "rid", F.col("annotator").cast("string").alias("annotator_id"), F.col("pred").cast("string").alias("label")
    )


@query(
    "most_frequent_labels", "A12",
    "SELECT dataset, annotator::VARCHAR AS annotator_id, label::VARCHAR AS most_frequent FROM frequent",
)
def _(t):
    return t.frequent


@query(
    "most_frequent_distance", "A13 P7 P23",
    """SELECT l.dataset, l.split, l.dataset_idx, round(avg(abs(f.label - l.pred) / (n_classes - 1)::DOUBLE), 6) AS avg_abs_dist
       FROM labelled l JOIN frequent f USING (dataset, annotator) GROUP BY l.dataset, l.split, l.dataset_idx""",
)
def _(t):
    return rounded(votes.by_item(votes.most_frequent_baseline(t.annotation_rows)))


@query(
    "category_label_rows", "P8",
    """SELECT event_id, c AS category, contains(CASE WHEN event_id % 3 = 0 THEN 'entailment,neutral' ELSE 'contradiction' END, c)::INT AS pred
       FROM events, (SELECT unnest(['entailment', 'neutral', 'contradiction']) AS c)""",
)
def _(t):
    label = F.when(F.col("event_id") % 3 == 0, "entailment,neutral").otherwise("contradiction")
    rows = t.events.select("event_id", label.alias("label"))
    return votes.category_labels(rows).select("event_id", "category", "pred")


@view(
    "position_votes",
    """SELECT dataset, split, dataset_idx, pos, label FROM (
         SELECT *, row_number() OVER (PARTITION BY dataset, split, dataset_idx, pos ORDER BY n DESC, first_run, label) AS rn FROM (
           SELECT dataset, split, dataset_idx, pos, label, count(*) AS n, min(run_idx) AS first_run FROM (
             SELECT *, unnest(preds) AS label, generate_subscripts(preds, 1) - 1 AS pos FROM label_lists) GROUP BY ALL)) WHERE rn = 1""",
)
def position_votes(t):
    return votes.position_votes(t.label_lists, ITEM, [F.col("run_idx"), F.col("label")])


@query(
    "position_majority", "A14",
    "SELECT dataset, split, dataset_idx, pos, label AS pred FROM position_votes",
)
def _(t):
    return t.position_votes.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "majority_vote_lists", "A14 A15",
    """SELECT dataset, split, dataset_idx, string_agg(label::VARCHAR, ',' ORDER BY pos) AS preds FROM position_votes GROUP BY ALL""",
)
def _(t):
    lists = votes.position_lists(t.position_votes, ITEM)
    return lists.select(
        *ITEM, F.array_join(F.transform("pred", lambda x: x.cast("string")), ",").alias("preds")
    )


@query(
    "majority_vote_distance", "A15 P34 F13",
    """WITH v AS (SELECT dataset, split, dataset_idx, list(label ORDER BY pos) AS voted FROM position_votes GROUP BY ALL),
     j AS (SELECT l.dataset, l.n_classes, v.voted, l.targets FROM label_lists l
           JOIN v USING (dataset, split, dataset_idx) WHERE len(v.voted) = len(l.targets))
     SELECT dataset, round(avg(list_avg(list_transform(range(1, len(voted) + 1), lambda i: abs(voted[i] - targets[i])::DOUBLE)) / (n_classes - 1)), 6) AS avg_abs_dist,
            count(*) AS n FROM j GROUP BY dataset""",
)
def _(t):
    lists = votes.position_lists(t.position_votes, ITEM)
    items = t.label_lists.drop("pred")
    scored = metrics.with_metrics(joins.join_items(items, lists), "perspectivist")
    return rounded(
        scored.groupBy("dataset").agg(F.avg("avg_abs_dist").alias("avg_abs_dist"), F.count(F.lit(1)).alias("n"))
    )


# Votes of an annotator over their answers to the same items.
@view(
    "rule_votes",
    """SELECT dataset, split, dataset_idx, target, mode, lo, hi FROM (
         SELECT dataset, split, dataset_idx, target, quantile_disc(pred, 0.5) AS lo, -quantile_disc(-pred, 0.5) AS hi FROM labelled GROUP BY ALL)
       JOIN (SELECT dataset, split, dataset_idx, target, pred AS mode FROM (
              SELECT *, row_number() OVER (PARTITION BY dataset, split, dataset_idx, target ORDER BY n DESC, pred) AS rn FROM (
                SELECT dataset, split, dataset_idx, target, pred, count(*) AS n FROM labelled GROUP BY ALL)) WHERE rn = 1)
       USING (dataset, split, dataset_idx, target)""",
)
def rule_votes(t):
    return votes.all_votes(t.labelled, [*ITEM, "target"])


@query(
    "vote_rules", "A16",
    """SELECT dataset, split, dataset_idx, target, unnest(['maj(mode)', 'maj(median_low)', 'maj(median_high)']) AS name,
              unnest([mode, lo, hi]) AS pred FROM rule_votes""",
)
def _(t):
    return t.rule_votes


@query(
    "single_vote_rule", "A16",
    "SELECT dataset, split, dataset_idx, lo AS pred FROM (SELECT dataset, split, dataset_idx, quantile_disc(pred, 0.5) AS lo FROM labelled GROUP BY ALL)",
)
def _(t):
    return votes.vote(t.labelled, "median_low", ITEM)


@view(
    "eval_rows",
    """SELECT dataset, split, dataset_idx, target, name, pred FROM (
         SELECT dataset, split, dataset_idx, target, 'simple' AS name, pred FROM labelled UNION ALL
         SELECT dataset, split, dataset_idx, target, unnest(['maj(mode)', 'maj(median_low)', 'maj(median_high)']) AS name, unnest([mode, lo, hi]) AS pred FROM rule_votes)""",
)
def eval_rows(t):
    return evaluation.with_all_votes(t.labelled.select(*ITEM, "target", "pred"))


@query(
    "label_evaluation", "A25 A28 P35 U2 U7",
    """SELECT name, dataset, round(avg((pred = target)::INT), 6) AS correct, count(*) AS count,
              round(avg(abs(pred - target) / (CASE dataset WHEN 'CSC' THEN 6 WHEN 'MP' THEN 1 ELSE 10 END)::DOUBLE), 6) AS abs_dist
       FROM eval_rows GROUP BY name, dataset""",
)
def _(t):
    return rounded(evaluation.label_accuracy(t.eval_rows, ["name", "dataset"]))


@query(
    "label_f1", "A26 A28",
    """SELECT name, dataset, round(2 * tp / nullif(pp + ap, 0)::DOUBLE, 6) AS f1, round(tp / nullif(pp, 0)::DOUBLE, 6) AS precision,
              round(tp / nullif(ap, 0)::DOUBLE, 6) AS recall, n AS count FROM (
         SELECT name, dataset, count(*) FILTER (pred = 1 AND target = 1) AS tp, count(*) FILTER (pred = 1) AS pp,
                count(*) FILTER (target = 1) AS ap, count(*) AS n FROM eval_rows WHERE dataset = 'MP' GROUP BY ALL)""",
)
def _(t):
    return rounded(evaluation.label_f1(t.eval_rows, ["name", "dataset"]))


@query(
    "quality_toxicity_f1", "A26",
    """SELECT 'labels' AS name, round(2 * tp / (pp + ap)::DOUBLE, 6) AS f1, round(tp / pp::DOUBLE, 6) AS precision, round(tp / ap::DOUBLE, 6) AS recall, n AS count
       FROM (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1) AS pp, count(*) FILTER (toxic = 1) AS ap, count(*) AS n FROM labels)""",
)
def _(t):
    df = t.labels.withColumn("name", F.lit("labels"))
    return rounded(agreement.binary_scores(df, ["name"], target="toxic", pred="quality"))


@query(
    "soft_label_evaluation", "A27 A28 J16",
    """WITH s AS (SELECT name, dataset, split, dataset_idx, k.k AS class_idx, count(*) FILTER (pred + (CASE dataset WHEN 'Paraphrase' THEN 5 ELSE 0 END) = k.k) / count(*)::DOUBLE AS p
                  FROM eval_rows, range(11) k(k) GROUP BY ALL),
     c AS (SELECT s.*, sum(s.p - g.target) OVER (PARTITION BY s.name, s.dataset, s.split, s.dataset_idx ORDER BY s.class_idx) AS gap
           FROM s JOIN targets g USING (dataset, split, dataset_idx, class_idx)),
     w AS (SELECT name, dataset, split, dataset_idx, sum(abs(gap)) AS ws FROM c GROUP BY ALL)
     SELECT name, dataset, round(avg(ws), 6) AS ws_loss, count(*) AS count FROM w GROUP BY name, dataset""",
)
def _(t):
    return rounded(evaluation.soft_label_scores(t.eval_rows, t.targets, ["name"]))


@query(
    "best_by_score", "A18 A45",
    """SELECT dataset, split, dataset_idx, rid, score FROM (
         SELECT *, row_number() OVER (PARTITION BY dataset, split, dataset_idx ORDER BY score DESC, run_idx, rid) AS rn FROM answers) WHERE rn = 1""",
)
def _(t):
    tie = [F.col("run_idx"), F.col("rid")]
    return selection.best_by_score(t.answers, ITEM, tie=tie).select(*ITEM, "rid", "score")


@query(
    "user_difficulty", "A19",
    "SELECT user_id, round(avg((event_type = 'purchase')::INT), 6) AS correct, count(*) AS n_solutions FROM events GROUP BY ALL",
)
def _(t):
    from dissensus.sources import rated_steps

    df = t.events.withColumn("correct", F.col("event_type") == "purchase")
    return rounded(rated_steps.difficulty(df, "user_id"))


@query(
    "correctness_levels", "A20",
    """SELECT dataset_idx, w AS incorrect, r AS correct, w > 0 AND r = 0 AS all_incorrect, w = 0 AND r > 0 AS all_correct, w > 0 AND r > 0 AS mixed FROM (
         SELECT dataset_idx, count(*) FILTER (pred <> target) AS w, count(*) FILTER (pred = target) AS r FROM labelled GROUP BY ALL)""",
)
def _(t):
    df = t.labelled.withColumn("is_correct", F.col("pred") == F.col("target"))
    return reshape.correctness_levels(df)


@query(
    "correctness_level_rows", "A20 U6",
    """SELECT dataset_idx, CASE WHEN w > 0 AND r = 0 THEN 'all_incorrect' WHEN w = 0 THEN 'all_correct' ELSE 'mixed' END AS correct_level FROM (
         SELECT dataset_idx, count(*) FILTER (pred <> target) AS w, count(*) FILTER (pred = target) AS r FROM labelled GROUP BY ALL)""",
)
def _(t):
    df = t.labelled.withColumn("is_correct", F.col("pred") == F.col("target"))
    return reshape.correctness_level_rows(reshape.correctness_levels(df))


# --- diversity ----------------------------------------------------------------------

@view(
    "spread",
    """SELECT dataset, split, dataset_idx, CASE WHEN max(n) < 2 THEN 0 ELSE sum((2 * r - n - 1) * cdf) / max(n * (n - 1) / 2.0::DOUBLE) END AS pairwise FROM (
         SELECT dataset, split, dataset_idx, class_idx, cdf, row_number() OVER w AS r, count(*) OVER (PARTITION BY dataset, split, dataset_idx, class_idx) AS n FROM (
           SELECT *, sum(p) OVER (PARTITION BY dataset, split, rid ORDER BY class_idx) AS cdf FROM soft)
         WINDOW w AS (PARTITION BY dataset, split, dataset_idx, class_idx ORDER BY cdf)) GROUP BY ALL""",
)
def spread(t):
    return diversity.pairwise_wasserstein(t.soft.select(*ITEM, "pred"))


@query(
    "pairwise_diversity", "A21",
    "SELECT dataset, split, dataset_idx, round(pairwise, 6) AS avg_pairwise_ws_loss FROM spread",
)
def _(t):
    return rounded(t.spread)


@query(
    "part_diversity_quintiles", "A22 W3",
    """WITH c AS (SELECT *, sum(p) OVER (PARTITION BY dataset, rid ORDER BY class_idx) AS cdf FROM soft),
     r AS (SELECT dataset, part, class_idx, cdf, row_number() OVER (PARTITION BY dataset, part, class_idx ORDER BY cdf) AS r,
                  count(*) OVER (PARTITION BY dataset, part, class_idx) AS n FROM c),
     d AS (SELECT dataset, part, CASE WHEN max(n) < 2 THEN 0 ELSE round(sum((2 * r - n - 1) * cdf) / max(n * (n - 1) / 2.0::DOUBLE), 9) END AS v FROM r GROUP BY ALL),
     e AS (SELECT dataset, quantile_cont(v, [0.2, 0.4, 0.6, 0.8]) AS q FROM d GROUP BY ALL)
     SELECT dataset, CASE WHEN v <= q[1] THEN 'Q1' WHEN v <= q[2] THEN 'Q2' WHEN v <= q[3] THEN 'Q3' WHEN v <= q[4] THEN 'Q4' ELSE 'Q5' END AS diversity,
            count(*) AS n, round(avg(v), 6) AS mean FROM d JOIN e USING (dataset) GROUP BY ALL""",
)
def _(t):
    keys = ["dataset", "part"]
    value = diversity.pairwise_wasserstein(t.soft.select(*keys, "pred"), keys)
    value = written(value.withColumn("avg_pairwise_ws_loss", F.round("avg_pairwise_ws_loss", 9)), "spread")
    tagged = diversity.with_quintile(value, by=["dataset"])
    return rounded(
        tagged.groupBy("dataset", "diversity").agg(
            F.count(F.lit(1)).alias("n"), F.avg("avg_pairwise_ws_loss").alias("mean")
        )
    )


@query(
    "score_quintiles", "W3",
    """WITH e AS (SELECT quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS e FROM answers)
       SELECT dataset, split, rid, CASE WHEN score <= e[1] THEN 'Q1' WHEN score <= e[2] THEN 'Q2' WHEN score <= e[3] THEN 'Q3' WHEN score <= e[4] THEN 'Q4' ELSE 'Q5' END AS diversity
       FROM answers, e""",
)
def _(t):
    return diversity.with_quintile(t.answers, "score").select(*KEY, "diversity")


@query(
    "most_diverse_answers", "F19 J11 A22",
    """WITH v AS (SELECT dataset, split, dataset_idx, round(pairwise, 9) AS v FROM spread), e AS (SELECT quantile_cont(v, 0.8) AS q FROM v)
       SELECT s.dataset, s.split, s.rid, round(v.v, 6) AS avg_pairwise_ws_loss FROM answers s JOIN v USING (dataset, split, dataset_idx), e WHERE v.v > e.q""",
)
def _(t):
    value = written(t.spread.withColumn("avg_pairwise_ws_loss", F.round("avg_pairwise_ws_loss", 9)), "spread")
    tagged = diversity.with_quintile(value)
    kept = diversity.most_diverse(t.answers, tagged)
    return rounded(diversity.with_diversity(kept, tagged).select(*KEY, "avg_pairwise_ws_loss"))


@query(
    "captured_improvement", "A36 U6",
    """WITH v AS (SELECT dataset, split, dataset_idx, round(pairwise, 9) AS v FROM spread),
     e AS (SELECT dataset, quantile_cont(v, [0.2, 0.4, 0.6, 0.8]) AS q FROM v GROUP BY ALL),
     b AS (SELECT v.dataset, v.split, v.dataset_idx, CASE WHEN v <= q[1] THEN 'Q1' WHEN v <= q[2] THEN 'Q2' WHEN v <= q[3] THEN 'Q3' WHEN v <= q[4] THEN 'Q4' ELSE 'Q5' END AS diversity
           FROM v JOIN e USING (dataset)),
     j AS (SELECT b.dataset, b.diversity, avg(s.ws_loss - a.ws_loss) AS m, avg(s.ws_loss - o.ws_loss) AS r
           FROM scored s JOIN b USING (dataset, split, dataset_idx) JOIN averaged_scored a USING (dataset, split, dataset_idx)
           JOIN best o USING (dataset, split, dataset_idx) GROUP BY ALL)
     SELECT dataset, diversity, round(m, 6) AS model_avg_improvement, round(r, 6) AS oracle_improvement,
            round(CASE WHEN abs(r) < 1e-9 THEN NULL ELSE m / r END, 4) AS fraction FROM j""",
)
def _(t):
    value = written(t.spread.withColumn("avg_pairwise_ws_loss", F.round("avg_pairwise_ws_loss", 9)), "spread")
    tagged = diversity.with_quintile(value, by=["dataset"])
    # Targets and distances are read several times; answers meet their item in one task.
    t.made["targets"] = written(t.targets, "targets")
    keys = joins.item_keys(t.soft, t.targets)
    n = ordering.rows_if_small(t.labelled, keys)
    if n is not None:
        t.made["soft"] = t.soft.repartition(ordering.n_tasks(t.spark, n), *keys)
        scored = t.scored.select(*keys, "run_idx", "rid", "ws_loss")
        order = [F.round("ws_loss", 9), F.col("run_idx"), F.col("rid")]
        marked = written(ordering.first_rows(scored, keys, order, mark="is_best").drop("run_idx", "rid"), "scored")
        t.made["scored"], t.made["best"] = marked, marked.where("is_best")
    gains = diversity.improvements(t.scored, t.averaged_scored, t.best, tagged)
    out = diversity.captured_fraction(gains, ["dataset", "diversity"])
    tiny = F.abs("oracle_improvement") < 1e-9
    return rounded(
        out.withColumn("fraction", F.round(F.when(~tiny, F.col("fraction")), 4))
    )


# --- progress, correlation, agreement -----------------------------------------------

@query(
    "validity_by_setting", "A23",
    """SELECT dataset, split, template_id, CASE model_id WHEN 'Qwen/Qwen3-32B' THEN '32.0' ELSE '14.0' END AS model_size, model_id,
              CASE gen_kwargs WHEN 'thinking' THEN 'set1' ELSE gen_kwargs END AS gen_kwargs,
              round(avg((abs(list_sum(ps) - 1) < 0.01)::INT), 6) AS is_valid_pred, count(*) AS validity_count FROM parsed GROUP BY ALL""",
)
def _(t):
    return rounded(evaluation.validity(t.parsed))


@query(
    "losses_by_setting", "A24",
    """SELECT dataset, split, template_id, model_id, gen_kwargs, round(avg(ws_loss), 6) AS avg_ws_loss, count(*) AS loss_count FROM scored GROUP BY ALL""",
)
def _(t):
    return rounded(evaluation.losses(t.scored))


@query(
    "score_correlation_by_part", "A31",
    """SELECT part, round(coalesce(CASE WHEN stddev_pop(score) = 0 OR stddev_pop(d) = 0 THEN 0 ELSE corr(score, d) END, 0), 6) AS corr FROM answers GROUP BY ALL""",
)
def _(t):
    return rounded(agreement.group_correlation(t.answers, ["part"], "score", "d"))


@query(
    "value_correlation_by_user", "A31",
    """SELECT user_id, round(corr(value, CAST(props ->> 'k' AS DOUBLE)), 6) AS corr FROM events GROUP BY ALL""",
)
def _(t):
    from dissensus.functions import text

    df = t.events.withColumn("k", text.parse(F.col("props"), "k double")["k"])
    return rounded(agreement.group_correlation(df, ["user_id"], "value", "k"))


@query(
    "rater_agreement", "A33",
    """SELECT dataset, round(avg((a = b)::INT), 6) AS agreement, count(*) AS n FROM (
         SELECT dataset, unnest([d % 3, t % 3, q % 3]) AS a, unnest([t % 3, q % 3, d % 3]) AS b FROM answers) GROUP BY ALL""",
)
def _(t):
    return rounded(agreement.equal_share(t.rating_pairs, ["dataset"]))


@view(
    "rating_pairs",
    "SELECT dataset, unnest([d % 3, t % 3, q % 3]) AS a, unnest([t % 3, q % 3, d % 3]) AS b FROM answers",
)
def rating_pairs(t):
    d, x, q = F.col("d") % 3, F.col("t") % 3, F.col("q") % 3
    df = t.answers.select("dataset", F.array(d, x, q).alias("h"), F.array(x, q, d).alias("m"))
    return agreement.rating_pairs(df, "h", "m", ["dataset"])


@query("rating_pair_counts", "A33", "SELECT a, b, count(*) AS n FROM rating_pairs GROUP BY ALL")
def _(t):
    return agreement.pair_counts(t.rating_pairs)


@query(
    "rater_alpha", "A34",
    """WITH u AS (SELECT dataset, a::DOUBLE AS v FROM rating_pairs UNION ALL SELECT dataset, b::DOUBLE FROM rating_pairs),
     e AS (SELECT dataset, count(*) AS n, (2 * count(*) * sum(v * v) - 2 * sum(v) * sum(v)) / (count(*) * (count(*) - 1.0::DOUBLE)) AS de FROM u GROUP BY ALL),
     o AS (SELECT dataset, avg((a - b) * (a - b)) AS d, count(*) AS n FROM rating_pairs GROUP BY ALL)
     SELECT o.dataset, round(1 - o.d / e.de, 6) AS alpha, o.n FROM o JOIN e USING (dataset)""",
)
def _(t):
    return rounded(agreement.interval_alpha(t.rating_pairs, ["dataset"]))


@query(
    "quality_toxicity_alpha", "A34 A33",
    """WITH u AS (SELECT quality::DOUBLE AS v FROM labels UNION ALL SELECT toxic::DOUBLE FROM labels),
     e AS (SELECT (2 * count(*) * sum(v * v) - 2 * sum(v) * sum(v)) / (count(*) * (count(*) - 1.0::DOUBLE)) AS de FROM u),
     o AS (SELECT avg((quality - toxic) * (quality - toxic)) AS d, count(*) AS n FROM labels)
     SELECT 'labels' AS name, round(1 - o.d / e.de, 6) AS alpha, o.n FROM o, e""",
)
def _(t):
    df = t.labels.withColumn("name", F.lit("labels"))
    return rounded(agreement.interval_alpha(df, ["name"], "quality", "toxic"))


# --- reports ------------------------------------------------------------------------

@query(
    "method_pivot", "A35 U7 S15",
    """WITH m AS (SELECT 'Simple Sampling' AS method, dataset, ws_loss FROM scored UNION ALL SELECT 'Model Averaging', dataset, ws_loss FROM averaged_scored
                  UNION ALL SELECT 'BoN Oracle', dataset, ws_loss FROM best)
       SELECT method, round(avg(ws_loss) FILTER (dataset = 'CSC'), 3) AS CSC, round(avg(ws_loss) FILTER (dataset = 'MP'), 3) AS MP,
              round(avg(ws_loss) FILTER (dataset = 'Paraphrase'), 3) AS PAR FROM m GROUP BY method""",
)
def _(t):
    frames = {"Simple Sampling": t.scored, "Model Averaging": t.averaged_scored, "BoN Oracle": t.best}
    rows = reshape.named({k: v.select("dataset", "ws_loss") for k, v in frames.items()}, "method")
    rows = rows.withColumn("dataset", registry.short_name(F.col("dataset")))
    return reshape.mean_pivot(rows, "method", "dataset", ["CSC", "MP", "PAR"], "ws_loss", 3)


@query(
    "entropy_and_loss_by_method", "A37",
    """WITH m AS (SELECT 'Simple Sampling' AS method, dataset, ws_loss, pred_entropy FROM scored UNION ALL
                  SELECT 'Model Averaging', dataset, ws_loss, pred_entropy FROM averaged_scored)
       SELECT method, dataset, round(100 * avg(pred_entropy), 4) AS pred_entropy, round(100 * avg(ws_loss), 4) AS ws_loss FROM m GROUP BY ALL""",
)
def _(t):
    cols = ["dataset", "ws_loss", "pred_entropy"]
    rows = reshape.named(
        {"Simple Sampling": t.scored.select(*cols), "Model Averaging": t.averaged_scored.select(*cols)}, "method"
    )
    return rounded(
        rows.groupBy("method", "dataset")
        .agg((100 * F.avg("pred_entropy")).alias("pred_entropy"), (100 * F.avg("ws_loss")).alias("ws_loss"))
        .orderBy("pred_entropy"),
        4,
    )


@query(
    "score_quartiles", "A38",
    """SELECT dataset, split, unnest([0.25, 0.75])::DOUBLE AS prob, round(unnest(quantile_cont(score, [0.25, 0.75])), 4) AS quantile FROM answers GROUP BY dataset, split""",
)
def _(t):
    return rounded(ordering.quantiles(t.answers, ["dataset", "split"], "score", [0.25, 0.75]), 4)


@query(
    "overall_score_quartiles", "A38",
    "SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS prob, round(unnest(quantile_cont(score, [0.25, 0.5, 0.75])), 4) AS quantile FROM answers",
)
def _(t):
    return rounded(ordering.quantiles(t.answers, [], "score", [0.25, 0.5, 0.75]), 4)


@query(
    "model_difference", "A39",
    """SELECT dataset_idx, round(avg(ws_loss) FILTER (model_id = 'Qwen/Qwen3-32B'), 6) AS a, round(avg(ws_loss) FILTER (model_id = 'Qwen/Qwen3-14B'), 6) AS b,
              round(avg(ws_loss) FILTER (model_id = 'Qwen/Qwen3-32B') - avg(ws_loss) FILTER (model_id = 'Qwen/Qwen3-14B'), 6) AS diff FROM scored GROUP BY ALL""",
)
def _(t):
    return rounded(
        reshape.model_difference(t.scored, "dataset_idx", "Qwen/Qwen3-32B", "Qwen/Qwen3-14B", "ws_loss")
    )


@query(
    "token_statistics", "A40 U6",
    """WITH p AS (SELECT dataset, model_id, 'n_input_tokens' AS part, part::BIGINT AS n FROM answers UNION ALL
                  SELECT dataset, model_id, 'n_output_tokens', q * d + t FROM answers)
       SELECT dataset, model_id, part, round(avg(n), 6) AS mean, sum(n)::BIGINT AS total, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.75) AS q75 FROM p GROUP BY ALL""",
)
def _(t):
    df = t.answers.select(
        "dataset", "model_id", F.col("part").alias("n_input_tokens"),
        (F.col("q") * F.col("d") + F.col("t")).cast("bigint").alias("n_output_tokens"),
    )
    return rounded(reshape.token_stats(df, ["dataset", "model_id"]))


@query(
    "dataset_row_statistics", "A42 S21",
    "SELECT dataset, count(*) AS n_rows, count(DISTINCT dataset_idx) AS n_items FROM answers GROUP BY ALL",
)
def _(t):
    return evaluation.group_sizes(t.answers)


@query(
    "earliest_answers", "A44",
    """SELECT dataset, split, dataset_idx, rid, ts FROM (
         SELECT *, row_number() OVER (PARTITION BY dataset, split, dataset_idx ORDER BY ts, rid) AS rn FROM answers) WHERE rn = 1""",
)
def _(t):
    return selection.earliest(t.answers, ITEM, "ts", [F.col("rid")]).select(*ITEM, "rid", "ts")


@query(
    "rater_means_by_part", "A45",
    "SELECT part, round(avg(sqrt(d)), 2) AS d, round(avg(sqrt(t)), 2) AS t FROM answers GROUP BY ALL",
)
def _(t):
    df = t.answers.select("part", F.sqrt("d").alias("d"), F.sqrt("t").alias("t"))
    return reshape.rater_means(df, "part", ["d", "t"])


@query(
    "soft_baselines", "A1 A2 A8 A9 A10 A11 P53 P34",
    """WITH sm AS (SELECT dataset, rid, split, sum(abs(gap)) AS ws, -sum(CASE WHEN s > 0 THEN s * ln(s) ELSE 0 END) AS h FROM (
           SELECT *, (p + 1.0 / n_classes) / 2 AS s, sum((p + 1.0 / n_classes) / 2 - target) OVER (PARTITION BY dataset, split, rid ORDER BY class_idx) AS gap FROM pairs) GROUP BY ALL),
     mv AS (SELECT dataset, class_idx, avg(target) AS p FROM targets GROUP BY ALL),
     mf AS (SELECT dataset, split, dataset_idx, sum(abs(gap)) AS ws, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS h FROM (
           SELECT g.*, mv.p, sum(mv.p - g.target) OVER (PARTITION BY g.dataset, split, dataset_idx ORDER BY g.class_idx) AS gap
           FROM targets g JOIN mv ON g.dataset = mv.dataset AND g.class_idx = mv.class_idx) GROUP BY ALL),
     un AS (SELECT dataset, split, dataset_idx, sum(abs(gap)) AS ws, max(ln(n_classes)) AS h FROM (
           SELECT *, sum(target - 1.0 / n_classes) OVER (PARTITION BY dataset, split, dataset_idx ORDER BY class_idx) AS gap FROM targets) GROUP BY ALL),
     u AS (SELECT 'Simple Sampling' AS method, dataset, ws_loss, pred_entropy FROM scored
           UNION ALL SELECT 'Model Averaging', dataset, ws_loss, pred_entropy FROM averaged_scored
           UNION ALL SELECT 'BoN Oracle', dataset, ws_loss, pred_entropy FROM (
             SELECT *, row_number() OVER (PARTITION BY dataset, split, dataset_idx ORDER BY round(ws_loss, 9), run_idx, rid) AS rn FROM scored) WHERE rn = 1
           UNION ALL SELECT 'Smoothing', dataset, ws, h FROM sm UNION ALL SELECT 'Most Frequent', dataset, ws, h FROM mf UNION ALL SELECT 'Uniform', dataset, ws, h FROM un)
     SELECT method, dataset, round(avg(ws_loss), 6) AS ws_loss, round(avg(pred_entropy), 6) AS pred_entropy FROM u GROUP BY ALL""",
)
def _(t):
    preds = t.soft.select(*ITEM, "n_classes", "rid", "run_idx", "pred")
    return rounded(reports.soft_baselines(preds, t.targets, tie=[F.col("rid")]))


@query(
    "mean_embedding_vectors", "A5 A6 A7",
    """SELECT label, k.k::INTEGER AS class_idx, round(avg(embedding[k.k + 1]::DOUBLE), 6) AS prob
       FROM embeddings, range(64) k(k) GROUP BY ALL""",
)
def _(t):
    """Mean of vectors longer than any label scheme's."""
    rows = t.embeddings.select("label", F.col("embedding").cast("array<double>").alias("pred"))
    return rounded(long_vector(distributions.mean_vectors(rows, ["label"], renormalise=False), ["label"]), 6)


@query(
    "wide_label_shares", "A5 A17",
    """SELECT l_returnflag, k.k::INTEGER AS class_idx, round(count(*) FILTER (CAST(l_quantity AS INTEGER) - 11 = k.k)
         / count(*) FILTER (CAST(l_quantity AS INTEGER) - 11 BETWEEN 0 AND 29)::DOUBLE, 6) AS prob
       FROM lineitem, range(30) k(k) GROUP BY ALL""",
)
def _(t):
    """Shares of thirty classes; other labels count in none."""
    index = F.col("l_quantity").cast("int") - 11
    return long_vector(distributions.label_shares(t.lineitem, ["l_returnflag"], index, F.lit(30)), ["l_returnflag"])


@query(
    "diversity_of_unknown_groups", "A22 A23",
    """WITH v AS (SELECT nullif(event_type, 'click') AS kind, event_id, value FROM events),
     q AS (SELECT kind, quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) AS q FROM v GROUP BY kind)
     SELECT event_id, CASE WHEN value <= q[1] THEN 'Q1' WHEN value <= q[2] THEN 'Q2' WHEN value <= q[3] THEN 'Q3'
                           WHEN value <= q[4] THEN 'Q4' ELSE 'Q5' END AS diversity
     FROM v JOIN q ON v.kind IS NOT DISTINCT FROM q.kind""",
)
def _(t):
    """Quintiles within groups, one of which has a null key."""
    rows = t.events.select("event_id", "value", F.expr("nullif(event_type, 'click')").alias("kind"))
    return diversity.with_quintile(rows, "value", by=["kind"]).select("event_id", "diversity")

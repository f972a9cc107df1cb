"""Joins over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dissensus.functions import ratings
from dissensus.operators import cleaning, evaluation, joins, metrics, reshape
from workloads import columns  # noqa: F401  (the views of text answers)
from workloads.base import query, rounded, view

KEY = ["dataset", "split", "rid"]


@query(
    "items_with_answers", "J1 J2",
    """SELECT s.dataset, s.split, s.dataset_idx, count(DISTINCT rid) AS n_answers, round(sum(p * g.target), 6) AS overlap
       FROM soft s JOIN targets g USING (dataset, split, dataset_idx, n_classes, class_idx) GROUP BY s.dataset, s.split, s.dataset_idx""",
)
def _(t):
    keys = ["dataset", "split", "dataset_idx"]
    items = joins.items_in_use(t.targets, t.answers)
    joined = joins.join_items(t.soft.select(*keys, "n_classes", "pred"), items)
    dot = F.aggregate(F.zip_with("pred", "target", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return rounded(
        joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_answers"), F.sum(dot).alias("overlap"))
    )


# Suppliers as annotators. Every other one is known by a name with the prefix Ann,
# those with a low balance not at all.
@view(
    "annotators",
    """SELECT 'all' AS dataset, s_suppkey AS suppkey, CASE WHEN s_acctbal < 1500 THEN NULL ELSE n_name END AS nation,
              CASE WHEN s_suppkey % 2 = 0 THEN 'Ann' ELSE '' END || s_suppkey AS seen_as
       FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def annotators(t):
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).where(
        F.col("s_acctbal") >= 1500
    ).select(
        F.lit("all").alias("dataset"), F.col("s_suppkey").cast("string").alias("annotator_id"),
        F.create_map(F.lit("nation"), "n_name").alias("attrs"),
    )


@query(
    "annotator_metadata", "J3 P9",
    """SELECT l.split, l.rid, a.seen_as AS annotator_id, a.nation, a.nation IS NULL AS is_default
       FROM labelled l JOIN annotators a ON l.annotator = a.suppkey""",
)
def _(t):
    name = F.concat(F.when(F.col("annotator") % 2 == 0, "Ann").otherwise(""), F.col("annotator"))
    rows = t.labelled.select(F.lit("all").alias("dataset"), "split", "rid", F.array(name).alias("annotator_ids"))
    df = joins.with_metadata(joins.annotator_rows(rows), t.annotators)
    return df.select(
        "split", "rid", "annotator_id",
        F.try_element_at("metadata", F.lit("nation")).alias("nation"),
        F.map_contains_key("metadata", F.lit("data")).alias("is_default"),
    )


@query(
    "accuracy_by_nation", "A41 P48 J3",
    """SELECT nation, round(avg((pred = target)::INT), 6) AS accuracy, count(*) AS n
       FROM labelled l JOIN annotators a ON l.annotator = a.suppkey GROUP BY ALL""",
)
def _(t):
    rows = t.labelled.select(
        F.lit("all").alias("dataset"), F.col("annotator").cast("string").alias("annotator_id"), "pred", "target"
    )
    return rounded(evaluation.accuracy_by_attribute(joins.with_metadata(rows, t.annotators), "nation"))


@query(
    "metadata_lists", "J3",
    """SELECT l.split, l.rid, 2::BIGINT AS n, coalesce(a.nation, '-') || ',' || coalesce(b.nation, '-') AS nations
       FROM labelled l JOIN annotators a ON l.annotator = a.suppkey LEFT JOIN annotators b ON l.annotator + 7 = b.suppkey""",
)
def _(t):
    ids = F.array(F.col("annotator").cast("string"), F.concat(F.lit("Ann"), F.col("annotator") + 7))
    items = t.labelled.select(
        F.lit("all").alias("dataset"), "split", F.col("rid").alias("dataset_idx"), ids.alias("annotator_ids")
    )
    lists = joins.collect_metadata(joins.with_metadata(joins.annotator_rows(items), t.annotators))
    nations = F.transform(
        "annotator_metadata", lambda m: F.coalesce(F.try_element_at(m, F.lit("nation")), F.lit("-"))
    )
    return lists.select(
        "split", F.col("dataset_idx").alias("rid"), F.size(nations).cast("bigint").alias("n"),
        F.array_join(nations, ",").alias("nations"),
    )


@query(
    "fewshot_examples", "J5 M1",
    """WITH e AS (SELECT o_orderkey AS dataset_idx, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5)
       SELECT dataset_idx, o_orderstatus AS response_llm, 'rated ' || o_orderstatus AS response_judge FROM e""",
)
def _(t):
    from dissensus.operators import selection

    items = t.orders.select(
        F.lit("all").alias("dataset"), F.lit("all").alias("split"), F.col("o_orderkey").alias("dataset_idx"),
        F.col("o_orderstatus").alias("response"),
    )
    head, _ = selection.head_and_tail(items, [F.col("dataset_idx")], 5)
    solutions = items.withColumn("response", F.concat(F.lit("rated "), "response"))
    return joins.fewshot_with_solutions(head, solutions).select("dataset_idx", "response_llm", "response_judge")


@query(
    "items_after_the_head", "M1",
    "SELECT o_orderkey AS dataset_idx FROM orders ORDER BY o_orderkey OFFSET 5",
)
def _(t):
    from dissensus.operators import selection

    items = t.orders.select(F.col("o_orderkey").alias("dataset_idx"))
    return selection.head_and_tail(items, [F.col("dataset_idx")], 5)[1]


@query(
    "predictions_in_item_order", "J6",
    """SELECT o_orderkey AS dataset_idx, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord, n FROM orders
       LEFT JOIN (SELECT dataset_idx, count(*) AS n FROM answers WHERE q > 25 GROUP BY ALL) ON dataset_idx = o_orderkey""",
)
def _(t):
    items = t.orders.select(
        F.lit("all").alias("dataset"), F.lit("all").alias("split"), F.col("o_orderkey").alias("dataset_idx")
    )
    preds = t.answers.where("q > 25").groupBy("dataset_idx").agg(F.count(F.lit(1)).alias("n"))
    return joins.in_item_order(preds, reshape.item_order(items)).select("dataset_idx", "ord", "n")


# Orders as items with three annotators each, who label every line of the order.
@view(
    "voted_items",
    """SELECT o_orderkey, ['A' || o_custkey, 'B' || o_orderkey % 5, 'C'] AS ids FROM orders""",
)
def voted_items(t):
    return t.orders.select(
        F.lit("MP").alias("dataset"), F.lit("test_clear").alias("split"), F.col("o_orderkey").alias("dataset_idx"),
        F.array(
            F.concat(F.lit("A"), "o_custkey"), F.concat(F.lit("B"), F.col("o_orderkey") % 5), F.lit("C")
        ).alias("annotator_ids"),
    )


@view(
    "annotator_votes",
    """SELECT o_orderkey AS dataset_idx, pos, pred FROM (
         SELECT *, row_number() OVER (PARTITION BY o_orderkey, pos ORDER BY n DESC, pred) AS rn FROM (
           SELECT o_orderkey, p.pos, CASE p.pos WHEN 0 THEN d % 2 WHEN 1 THEN t % 2 ELSE q % 2 END AS pred, count(*) AS n
           FROM voted_items JOIN answers ON dataset_idx = o_orderkey, (SELECT unnest([0, 1, 2]) AS pos) p GROUP BY ALL)) WHERE rn = 1""",
)
def annotator_labels(t):
    """Labels in rows of (item, annotator), the annotators in another order than the item's."""
    keys = ["dataset", "split", "dataset_idx"]
    lines = t.answers.select("dataset_idx", "d", "t", "q").join(t.voted_items, "dataset_idx")
    labels = F.arrays_zip(
        F.reverse("annotator_ids").alias("a"), F.array(F.col("q") % 2, F.col("t") % 2, F.col("d") % 2).alias("p")
    )
    return lines.select(*keys, F.explode(labels).alias("x")).select(
        *keys, F.col("x.a").alias("annotator_ids"), F.col("x.p").alias("pred")
    )


@query(
    "labels_in_annotator_order", "J7",
    "SELECT dataset_idx, string_agg(pred::VARCHAR, ',' ORDER BY pos) AS preds FROM annotator_votes GROUP BY ALL",
)
def _(t):
    from dissensus.operators import votes

    keys = ["dataset", "split", "dataset_idx", "annotator_ids"]
    lists = joins.labels_in_annotator_order(votes.vote(t.annotator_votes, "mode", keys), t.voted_items)
    return lists.select(
        "dataset_idx", F.array_join(F.transform("pred", lambda x: x.cast("string")), ",").alias("preds")
    )


@query(
    "graded_answers", "J9 P20 F15",
    """SELECT s.dataset, s.split, s.rid, round(s.ws_loss, 6) AS ws_loss, round(list_avg(j.ok0), 6) AS score
       FROM scored s JOIN judgements j ON s.rid = j.rid WHERE j.ok0 IS NOT NULL""",
)
def _(t):
    judged = evaluation.score_from_json(t.judgements.select("rid", "response"))
    joined = joins.join_grades(t.scored.drop("score"), judged.select("rid", "score"), ["rid"])
    return rounded(joined.select(*KEY, "ws_loss", "score"))


@query(
    "scalar_graded_answers", "P21 F15",
    "SELECT dataset, split, rid, d::DOUBLE AS score FROM answers WHERE t < 6",
)
def _(t):
    raw = F.when(F.col("t") < 6, F.concat(F.lit(" "), "d", F.lit(".0 "))).otherwise("n/a")
    df = t.answers.drop("score").withColumn("response", raw)
    return evaluation.score_from_number(df).select(*KEY, "score")


@query(
    "mixed_problem_answers", "J10 A20",
    """WITH lv AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS r, count(*) AS n FROM events GROUP BY ALL)
       SELECT event_id, user_id AS dataset_idx, (event_type = 'purchase')::INT AS is_correct FROM events
       WHERE user_id IN (SELECT user_id FROM lv WHERE r > 0 AND r < n)""",
)
def _(t):
    runs = t.events.select(
        "event_id", F.col("user_id").alias("dataset_idx"), F.col("event_id").alias("run_idx"),
        (F.col("event_type") == "purchase").cast("int").alias("is_correct"),
    )
    levels = reshape.correctness_level_rows(reshape.correctness_levels(runs))
    joined = joins.join_correctness(runs.drop("is_correct"), runs.drop("event_id"), levels)
    return joined.select("event_id", "dataset_idx", "is_correct")


@query(
    "rater_comparison", "J14",
    """SELECT rid, n::BIGINT AS n, same::BIGINT AS same FROM (SELECT rid, 3 AS n,
         (d % 3 = t % 3)::INT + (t % 3 = q % 3)::INT + (q % 3 = d % 3)::INT AS same FROM answers WHERE t <> 8)""",
)
def _(t):
    d, x, q = F.col("d") % 3, F.col("t") % 3, F.col("q") % 3
    human = t.answers.select("rid", F.array(d, x, q).alias("ratings"))
    model = t.answers.select(
        "rid", F.when(F.col("t") != 8, F.array(x, q, d)).otherwise(F.array(x)).alias("ratings")
    )
    both = joins.compare_raters(human, model, "rid")
    same = F.size(F.filter(F.zip_with("ratings_human", "ratings_model", lambda a, b: a == b), lambda e: e))
    return both.select("rid", F.size("ratings_human").cast("bigint").alias("n"), same.cast("bigint").alias("same"))


@query(
    "uniform_baseline_rows", "J15 A2",
    """SELECT dataset, split, dataset_idx, round(sum(abs(gap)), 6) AS ws_loss FROM (
         SELECT *, sum(target - 1.0 / n_classes) OVER (PARTITION BY dataset, split, dataset_idx ORDER BY class_idx) AS gap FROM targets)
       GROUP BY ALL""",
)
def _(t):
    return rounded(metrics.uniform_baseline(t.targets).select("dataset", "split", "dataset_idx", "ws_loss"))


@query(
    "numbered_problems", "J17",
    """SELECT doc_id, dense_rank() OVER (ORDER BY md5(text)) - 1 AS problem_id FROM documents""",
)
def _(t):
    df = t.documents.select("doc_id", F.md5("text").alias("problem"))
    return joins.numbered_problems(df).select("doc_id", "problem_id")


@query(
    "problem_ids", "J17",
    "SELECT md5(text) AS problem_id, count(*) AS n FROM documents GROUP BY ALL",
)
def _(t):
    return joins.problem_ids(t.documents, "text").groupBy("problem_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "step_count_equality", "A30",
    """SELECT round(avg(CASE WHEN ok0 IS NULL THEN 0 WHEN 2 + (turn_n % 2) = 3 THEN 1 ELSE 0 END), 6) AS fraction_equal, count(*) AS n
       FROM (SELECT *, d AS turn_n FROM judgements)""",
)
def _(t):
    from dissensus.operators import agreement

    steps = F.size(ratings.step_grades(ratings.parse_ratings(F.col("response")), ratings.GRADE_MAPPINGS["ok=0"]))
    df = t.judgements.select(steps.alias("a"), (2 + F.col("d") % 2).alias("b"))
    df = df.withColumn("a", F.when(F.col("a") >= 0, F.col("a")))
    return rounded(agreement.step_count_equality(df, F.col("a"), F.col("b")))


@query(
    "validity_and_losses", "J12 A23 A24",
    """WITH v AS (SELECT dataset, split, template_id, avg((abs(list_sum(ps) - 1) < 0.01)::INT) AS ok, count(*) AS n FROM parsed GROUP BY ALL),
     g AS (SELECT p.dataset, p.split, p.template_id, p.rid, k.class_idx, coalesce(ps[list_position(ks, k.class_idx)], 0) / list_sum(ps) AS p, k.target
           FROM parsed p JOIN targets k ON p.dataset = k.dataset AND p.split = k.split AND p.dataset_idx = k.dataset_idx
           WHERE abs(list_sum(ps) - 1) < 0.01),
     c AS (SELECT *, sum(p - target) OVER (PARTITION BY dataset, split, rid ORDER BY class_idx) AS gap FROM g),
     l AS (SELECT dataset, split, template_id, rid, sum(abs(gap)) AS ws FROM c GROUP BY ALL),
     m AS (SELECT dataset, split, template_id, avg(ws) AS ws, count(*) AS n FROM l GROUP BY ALL)
     SELECT v.dataset, v.split, v.template_id, round(v.ok, 6) AS is_valid_pred, v.n AS validity_count, round(m.ws, 6) AS avg_ws_loss, m.n AS loss_count
     FROM v LEFT JOIN m USING (dataset, split, template_id)""",
)
def _(t):
    keys = ["dataset", "split", "template_id"]
    preds = t.parsed
    valid = evaluation.validity(preds, keys)
    scored = metrics.with_soft_metrics(
        joins.join_items(cleaning.drop_invalid(preds).drop("category"), t.targets)
    )
    return rounded(evaluation.validity_and_losses(valid, evaluation.losses(scored, keys), keys))

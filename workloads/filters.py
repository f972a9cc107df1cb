"""Filters, validity checks and gates over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dissensus.functions import vectors
from dissensus.operators import cleaning, joins, reshape, selection
from dissensus.sources import submissions
from workloads.base import query, rounded

KEY = ["dataset", "split", "rid"]


@query(
    "successful_answers", "F1 F2 F4 F5",
    """SELECT dataset, split, rid, trim(response, E' \\t\\n\\r\\f\\v') AS response FROM responses
       WHERE coalesce(success, true) AND response IS NOT NULL AND trim(response, E' \\t\\n\\r\\f\\v') <> ''""",
)
def _(t):
    df = cleaning.drop_failed(t.responses)
    return cleaning.drop_blank(cleaning.drop_missing(df)).select(*KEY, "response")


@query(
    "answers_within_token_limit", "F3",
    """SELECT dataset, split, rid, coalesce(100 > q * t, false) AND coalesce(success, false) AS success FROM responses""",
)
def _(t):
    df = t.responses.withColumns({"max_tokens": F.lit(100), "n_output_tokens": F.col("q") * F.col("t")})
    return cleaning.recompute_success(df).select(*KEY, "success")


@query(
    "valid_answers", "F7 F8 F10",
    "SELECT dataset, split, rid FROM parsed WHERE abs(list_sum(ps) - 1) < 0.01",
)
def _(t):
    return cleaning.drop_invalid(t.parsed).select(*KEY)


@query(
    "rejected_answers", "P14 F7",
    """SELECT reason, dataset, count(*) AS n FROM (
         SELECT r.dataset, CASE WHEN NOT coalesce(r.success, true) THEN 'failed' WHEN r.t = 8 THEN 'no response'
                  WHEN r.t = 7 THEN 'blank response' WHEN p.rid IS NULL THEN 'not readable'
                  WHEN NOT abs(list_sum(p.ps) - 1) < 0.01 THEN 'not valid' END AS reason
         FROM responses r LEFT JOIN parsed p ON r.rid = p.rid AND r.dataset = p.dataset AND r.split = p.split)
       WHERE reason IS NOT NULL GROUP BY ALL""",
)
def _(t):
    return cleaning.rejected(t.responses).groupBy("reason", "dataset").agg(F.count(F.lit(1)).alias("n"))


@query(
    "category_answers", "F8 F9 P5 P6 P53 P32",
    """SELECT dataset_idx, rid, k.c AS category, round(1 - k.m / 100.0::DOUBLE, 6) AS p0, round(k.m / 100.0::DOUBLE, 6) AS p1, t <> 8 AS is_valid_pred
       FROM answers, (SELECT unnest(['entailment', 'neutral', 'contradiction']) AS c) n,
            LATERAL (SELECT n.c, CASE n.c WHEN 'entailment' THEN d * 10 WHEN 'neutral' THEN t * 12 ELSE q * 2 END AS m) k
       WHERE NOT (t = 8 AND k.c = 'contradiction')""",
)
def _(t):
    def part(name, mass):
        p = mass / F.lit(100.0)
        return F.concat(
            F.lit(f'"{name}": {{"0": '), (1 - p).cast("string"), F.lit(', "1": '), p.cast("string"), F.lit("}")
        )

    parts = [part("entailment", F.col("d") * 10), part("neutral", F.col("t") * 12)]
    last = F.when(F.col("t") < 8, F.concat(F.lit(", "), part("contradiction", F.col("q") * 2))).otherwise("")
    response = F.concat(F.lit("{"), F.concat_ws(", ", *parts), last, F.lit("}"))
    raw = t.answers.withColumns(
        {"dataset": F.lit("VariErrNLI"), "response": response, "success": F.lit(True)}
    )
    df = cleaning.clean(raw)
    return rounded(
        df.select("dataset_idx", "rid", "category", F.col("pred")[0].alias("p0"), F.col("pred")[1].alias("p1"), "is_valid_pred")
    )


@query(
    "labels_in_domain", "F11 F12 U5",
    """SELECT dataset, split, rid, pos, pred FROM (
         SELECT dataset, split, rid, 0 AS pos, d - 3 AS pred FROM answers UNION ALL
         SELECT dataset, split, rid, 1 AS pos, t AS pred FROM answers WHERE t < 8 UNION ALL
         SELECT dataset, split, rid, 2 AS pos, q - 20 AS pred FROM answers)
       WHERE pred BETWEEN CASE dataset WHEN 'CSC' THEN 1 WHEN 'MP' THEN 0 ELSE -5 END AND CASE dataset WHEN 'CSC' THEN 6 WHEN 'MP' THEN 1 ELSE 5 END""",
)
def _(t):
    samples = F.array(F.col("d") - 3, F.when(F.col("t") < 8, F.col("t")), F.col("q") - 20)
    df = t.answers.select(*KEY, F.posexplode(samples).alias("pos", "pred"))
    return cleaning.drop_invalid_labels(cleaning.drop_missing(df, "pred"))


@query(
    "sampled_label_counts", "U5 F4 F12",
    """SELECT dataset, pred, count(*) AS n FROM (
         SELECT dataset, unnest([d, t, q]) AS pred FROM answers)
       WHERE pred BETWEEN CASE dataset WHEN 'CSC' THEN 1 WHEN 'MP' THEN 0 ELSE -5 END AND CASE dataset WHEN 'CSC' THEN 6 WHEN 'MP' THEN 1 ELSE 5 END
       GROUP BY ALL""",
)
def _(t):
    df = t.answers.select("dataset", F.array("d", "t", "q").alias("pred"))
    return reshape.exploded_labels(df).groupBy("dataset", "pred").agg(F.count(F.lit(1)).alias("n"))


@query(
    "equal_length_lists", "F13 F14 P44",
    """SELECT dataset, split, rid, len(preds)::INTEGER AS n_pred_annotators FROM label_lists WHERE len(preds) = len(targets) AND len(preds) = n_annotators""",
)
def _(t):
    df = cleaning.same_annotators(cleaning.same_length(t.label_lists))
    return cleaning.annotator_count(df, KEY)


@query(
    "category_list_lengths", "F13 P44",
    """SELECT dataset, split, dataset_idx, count(*) AS n_runs, max(len(preds))::INTEGER AS longest,
              CASE WHEN min(len(preds)) = max(len(preds)) THEN max(len(preds))::INTEGER END AS n_pred_annotators
       FROM label_lists GROUP BY ALL HAVING sum(len(preds)) = sum(len(targets))""",
)
def _(t):
    keys = ["dataset", "split", "dataset_idx"]
    # The answers to an item stand in for the categories of an answer.
    df = t.label_lists.withColumn("category", F.col("run_idx").cast("string"))
    kept = cleaning.same_length(df, keys)
    counts = kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"), F.max(F.size("pred")).alias("longest")
    )
    return counts.join(cleaning.annotator_count(kept, keys), keys)


@query(
    "answers_of_one_setting", "F16",
    """SELECT dataset, split, rid FROM answers WHERE model_id = 'Qwen/Qwen3-32B' AND template_id = 31 AND gen_kwargs = 'set2'""",
)
def _(t):
    spec = {"model_id": "Qwen/Qwen3-32B", "template_id": 31, "gen_kwargs": "set2", "judge_model_id": "x"}
    return cleaning.equal_to(t.answers, spec).select(*KEY)


@query(
    "answers_to_grade_first", "F17",
    """SELECT dataset, split, rid FROM answers WHERE run_idx < 3
       AND dataset_idx IN (SELECT DISTINCT dataset_idx FROM answers WHERE run_idx < 3 ORDER BY dataset_idx LIMIT 500)""",
)
def _(t):
    asked = t.answers.where("run_idx < 3")
    return selection.answers_to_grade(asked, 500, 3).select(*KEY)


@query(
    "answers_to_grade_random", "F17 M5",
    """SELECT dataset, split, rid FROM answers WHERE run_idx < 3
       AND dataset_idx IN (SELECT dataset_idx FROM (SELECT DISTINCT dataset_idx FROM answers) ORDER BY md5('0|' || dataset_idx), dataset_idx LIMIT 500)""",
)
def _(t):
    return selection.answers_to_grade(t.answers, 500, 3, at_random=True).select(*KEY)


@query(
    "position_shards", "F18",
    """SELECT shard, count(*) AS n, sum(dataset_idx)::BIGINT AS ids FROM (
         SELECT dataset_idx, (row_number() OVER (ORDER BY dataset_idx, rid) - 1) % 3 AS shard FROM answers) GROUP BY ALL""",
)
def _(t):
    order = [F.col("dataset_idx"), F.col("rid")]
    parts = [
        selection.shard_by_position(t.answers, order, rank, 3)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("dataset_idx").alias("ids"))
        .withColumn("shard", F.lit(rank).cast("bigint"))
        for rank in range(3)
    ]
    return reshape.stacked(*parts).select("shard", "n", "ids")


@query(
    "hash_shards", "F18",
    "SELECT count(*) AS n, sum(dataset_idx)::BIGINT AS ids FROM answers",
)
def _(t):
    keys = ["dataset", "split", "dataset_idx"]
    parts = [selection.shard(t.answers, keys, rank, 3) for rank in range(3)]
    return reshape.stacked(*parts).agg(F.count(F.lit(1)).alias("n"), F.sum("dataset_idx").alias("ids"))


@query(
    "half_correct_users", "F20",
    """SELECT event_id, user_id FROM events WHERE user_id IN (
         SELECT user_id FROM events GROUP BY user_id HAVING 2 * count(*) FILTER (value > 34) = count(*) ORDER BY user_id LIMIT 10)""",
)
def _(t):
    df = t.events.withColumn("correct", F.col("value") > 34)
    return selection.half_correct_problems(df, 10, "user_id").select("event_id", "user_id")


@query(
    "common_items", "F22 U8",
    """SELECT dataset_idx FROM answers WHERE template_id = 31 INTERSECT SELECT dataset_idx FROM answers WHERE template_id = 60""",
)
def _(t):
    a = t.answers
    return reshape.common_ids(a.where("template_id = 31"), a.where("template_id = 60"))


@query(
    "template_means_of_common_items", "F22 F16 A1",
    """SELECT template_id, round(avg(ws_loss), 6) AS ws_loss, count(*) AS n FROM scored WHERE dataset_idx IN (
         SELECT dataset_idx FROM scored WHERE template_id = 31 INTERSECT SELECT dataset_idx FROM scored WHERE template_id = 60)
       GROUP BY ALL""",
)
def _(t):
    a = t.answers
    ids = reshape.common_ids(a.where("template_id = 31"), a.where("template_id = 60"))
    means = selection.only_items(t.scored, ids).groupBy("template_id")
    return rounded(means.agg(F.avg("ws_loss").alias("ws_loss"), F.count(F.lit(1)).alias("n")))


@query(
    "sum_to_one_check", "F23",
    """SELECT dataset, count(*) AS n, count(*) FILTER (abs(s - 1) >= 1e-6) AS invalid
       FROM (SELECT dataset, list_sum(ps) AS s FROM parsed) GROUP BY ALL""",
)
def _(t):
    ok = vectors.sums_to_one(F.col("pred"), 1e-6)
    return t.parsed.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("invalid"))


@query(
    "annotator_count_check", "F24",
    """SELECT 'all' AS dataset, split, rid AS dataset_idx, len(preds)::INTEGER AS n_pred_annotators, len(targets)::INTEGER AS n_item_annotators
       FROM label_lists WHERE len(preds) <> len(targets)""",
)
def _(t):
    rows = t.label_lists.select(
        F.lit("all").alias("dataset"), "split", F.col("rid").alias("dataset_idx"), "pred",
        F.col("target").alias("annotator_ids"),
    )
    return submissions.annotator_mismatches(rows.drop("annotator_ids"), rows.drop("pred"))


@query(
    "answer_count_check", "F25",
    """SELECT count(DISTINCT dataset_idx) * 7 AS expected, count(DISTINCT (dataset_idx, run_idx)) AS found,
              abs(found - expected) > 1e-8 + 0.01 * expected AS off FROM answers""",
)
def _(t):
    return submissions.row_check(t.answers, t.answers, runs=7)


@query(
    "missing_runs", "J4 U9",
    """SELECT o_orderkey AS dataset_idx, r.r::INTEGER AS run_idx FROM orders, range(3) r(r)
       WHERE (o_orderkey, r.r) NOT IN (SELECT (dataset_idx, run_idx) FROM answers WHERE q > 10)""",
)
def _(t):
    wanted = t.orders.select(
        F.lit("all").alias("dataset"), F.lit("all").alias("split"), F.col("o_orderkey").alias("dataset_idx"),
        F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("run_idx"),
    )
    done = t.answers.withColumns({"dataset": F.lit("all"), "split": F.lit("all"), "success": F.col("q") > 10})
    return joins.missing_answers(wanted, done).select("dataset_idx", "run_idx")

"""Reading, writing, stacking, exploding and result files over whole tables."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissensus.operators import batches, evaluation, joins, metrics, ordering, reshape, selection
from dissensus.plans import reports, submit
from dissensus.session import scratch_folder, written
from dissensus.sources import answers as answer_source
from dissensus.sources import items as item_source
from dissensus.sources import keyed_json, rated_steps, submissions
from workloads import columns, joining, reductions  # noqa: F401  (their views are used)
from workloads.base import query, r6, rounded, view

ITEM = ["dataset", "split", "dataset_idx"]
KEY = ["dataset", "split", "rid"]


# --- reading and writing ------------------------------------------------------------

@query(
    "parquet_folder_of_changing_columns", "S3 S4 F3 S17",
    """SELECT rid, CASE WHEN dataset = 'MP' THEN false ELSE coalesce(success, false) AND 100 > q * t END AS success, CASE WHEN dataset <> 'MP' THEN 100 END AS max_tokens
       FROM responses""",
)
def _(t):
    folder = scratch_folder(t.spark, "answers")
    df = t.responses.select("dataset", "rid", "success", (F.col("q") * F.col("t")).alias("n_output_tokens"))
    limited = df.where("dataset <> 'MP'").withColumn("max_tokens", F.lit(100))
    limited.drop("dataset").write.parquet(f"{folder}/part=limited")
    df.where("dataset = 'MP'").drop("dataset").write.parquet(f"{folder}/part=plain")
    return answer_source.read_folder(t.spark, folder).select("rid", "success", "max_tokens")


@query(
    "listed_parquet_files", "S4 S14 U1",
    "SELECT CASE l_returnflag WHEN 'A' THEN 'CSC' WHEN 'N' THEN 'MP' ELSE 'Paraphrase' END AS dataset, count(*) AS n, count(*) FILTER (l_returnflag = 'A')::BIGINT AS n_extra FROM lineitem GROUP BY ALL",
)
def _(t):
    folder = scratch_folder(t.spark, "listed")
    rows = t.answers.select("dataset", "rid")
    rows.where("dataset = 'CSC'").withColumn("extra", F.lit(1)).write.parquet(f"{folder}/a")
    rows.where("dataset <> 'CSC'").write.parquet(f"{folder}/b")
    df = answer_source.read_files(t.spark, [f"{folder}/a", f"{folder}/b"])
    return df.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count("extra").alias("n_extra"))


@query(
    "json_lines_round_trip", "S5 S6 S7 S8",
    "SELECT dataset, split, dataset_idx, run_idx, model_id, response, success, true AS stamped FROM responses",
)
def _(t):
    folder = scratch_folder(t.spark, "lines")
    cols = [*ITEM, "run_idx", "model_id", "template_id", "gen_kwargs", "response", "success"]
    answer_source.append_answers(t.responses.select(*cols), f"{folder}/first/run")
    raw = answer_source.read_json_lines(t.spark, folder, "*.json")
    path = f"{folder}/table"
    raw.drop("run_start").write.parquet(path)
    df = answer_source.read_files(t.spark, [path])
    return df.select(*ITEM, "run_idx", "model_id", "response", "success", F.col("timestamp").isNotNull().alias("stamped"))


@query(
    "keyed_json_items", "S1",
    """SELECT o_orderkey AS dataset_idx, '{"' || o_orderpriority || '\\}, {' AS post, o_orderstatus AS label, 1::INTEGER AS n FROM orders""",
)
def _(t):
    # Texts with braces, quotes and backslashes, over which the files are cut.
    path = scratch_folder(t.spark, "keyed")
    post = F.concat(F.lit('{"'), "o_orderpriority", F.lit("\\}, {"))
    item = F.struct(
        F.create_map(F.lit("post"), post).alias("text"),
        F.create_map(F.lit("Ann1"), "o_orderstatus").alias("annotations"),
        F.lit(1).alias("number of annotators"),
    )
    keyed_json.write(t.orders.select(F.col("o_orderkey").alias("key"), item.alias("value")), path)
    df = item_source.read_keyed_json(t.spark, f"{path}/file=*")
    return df.select(
        "dataset_idx", F.col("text")["post"].alias("post"), F.col("annotations")["Ann1"].alias("label"),
        F.col("number of annotators").alias("n"),
    )


@query(
    "converted_items", "S1 S2 J3 P9 P10 P12",
    """WITH o AS (SELECT o_orderkey, o_custkey % 50 + 1 AS who, (o_orderkey % 5) / 4.0::DOUBLE AS p FROM orders)
       SELECT o_orderkey AS dataset_idx, 'train' AS split, p > 0 AND p < 1 AS tgt_has_holes,
              round(CASE WHEN p > 0 AND p < 1 THEN -p * ln(p) - (1 - p) * ln(1 - p) ELSE 0 END, 6) AS target_entropy,
              11::INTEGER AS n_classes, 'Ann' || who AS annotator, coalesce(nation, '-') AS nation
       FROM o LEFT JOIN annotators a ON a.suppkey = o.who""",
)
def _(t):
    """Keyed items and annotators from files, converted once, with targets and metadata."""
    path = scratch_folder(t.spark, "items")
    p = (F.col("o_orderkey") % 5) / 4
    who = F.concat(F.lit("Ann"), (F.col("o_custkey") % 50 + 1).cast("string"))
    item = F.struct(
        F.create_map(F.lit("post"), "o_orderpriority").alias("text"),
        F.create_map(F.lit("-5"), p, F.lit("5"), 1 - p).alias("soft_label"),
        F.create_map(who, F.lit("1")).alias("annotations"),
        F.lit(1).alias("number of annotators"),
        F.lit(1).alias("number of annotations"),
    )
    keyed_json.write(t.orders.select(F.col("o_orderkey").alias("key"), item.alias("value")), f"{path}/raw")
    people = t.annotators.select(F.col("annotator_id").alias("key"), F.col("attrs").alias("value"))
    keyed_json.write(people, f"{path}/people")
    item_source.convert_keyed_json(t.spark, f"{path}/raw/file=*", f"{path}/table", "Paraphrase", "train")
    annotators = item_source.read_annotators(t.spark, f"{path}/people/file=*", "Paraphrase")
    items = item_source.read_items(t.spark, f"{path}/table", ["Paraphrase"], ["train"])
    df = item_source.load_items(items, annotators)
    nation = F.try_element_at(F.col("annotator_metadata")[0], F.lit("nation"))
    return df.select(
        F.col("dataset_idx").cast("bigint").alias("dataset_idx"), "split", "tgt_has_holes",
        r6("target_entropy").alias("target_entropy"), "n_classes",
        F.col("annotator_ids")[0].alias("annotator"), F.coalesce(nation, F.lit("-")).alias("nation"),
    )


@query(
    "answers_with_file", "S13",
    "SELECT event_type, count(*) AS n, true AS in_events_file FROM events GROUP BY ALL",
)
def _(t):
    df = answer_source.read_with_file(t.spark, [t.path("events")])
    return df.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.every(F.contains("preds_file", F.lit("events.parquet"))).alias("in_events_file")
    )


@query(
    "csv_export", "S15",
    "SELECT dataset, split, round(avg(score), 3) AS score, count(*) AS n FROM answers GROUP BY ALL",
)
def _(t):
    path = scratch_folder(t.spark, "csv")
    means = t.answers.groupBy("dataset", "split").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"))
    answer_source.write_csv(means, path)
    return t.spark.read.schema("dataset string, split string, score double, n bigint").option("header", True).csv(path)


@query(
    "subset_export", "S16",
    """SELECT dataset, split, rid FROM answers WHERE dataset_idx IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def _(t):
    path = scratch_folder(t.spark, "subset")
    ids = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("dataset_idx"))
    answer_source.write_subset(t.answers, ids, path)
    return t.spark.read.parquet(path).select(*KEY)


@query(
    "label_export", "S18",
    "SELECT dataset, split, dataset_idx, annotator::VARCHAR AS annotator_ids, pred, target FROM labelled",
)
def _(t):
    path = scratch_folder(t.spark, "labels")
    df = t.labelled.withColumn("annotator_ids", F.col("annotator").cast("string"))
    answer_source.write_columns(df, path)
    return t.spark.read.parquet(path)


@query(
    "expected_runs", "S19",
    """SELECT s.s AS split, d.d AS dataset, m.m AS model_id, t.t AS template_id, EXISTS (SELECT 1 FROM answers a WHERE a.split = s.s AND a.dataset = d.d AND a.model_id = m.m AND a.template_id = t.t) AS exists
       FROM (SELECT unnest(['train', 'dev', 'test_clear']) AS s) s, (SELECT unnest(['CSC', 'MP', 'Paraphrase', 'VariErrNLI']) AS d) d,
            (SELECT unnest(['Qwen/Qwen3-32B', 'Qwen/Qwen3-14B', 'Qwen/Qwen3-8B']) AS m) m, (SELECT unnest([3, 31, 60]) AS t) t""",
)
def _(t):
    expected = answer_source.expected_runs(
        t.spark,
        split=["train", "dev", "test_clear"],
        dataset=["CSC", "MP", "Paraphrase", "VariErrNLI"],
        model_id=["Qwen/Qwen3-32B", "Qwen/Qwen3-14B", "Qwen/Qwen3-8B"],
        template_id=[3, 31, 60],
    )
    return answer_source.catalogue(expected, t.answers)


@query(
    "dataset_sizes", "S21",
    "SELECT dataset, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'dev') AS dev FROM answers GROUP BY ALL",
)
def _(t):
    return evaluation.dataset_sizes(t.answers, ["train", "dev"])


@query(
    "dataset_sizes_long", "S21",
    "SELECT dataset, split, count(*) AS n_rows FROM answers GROUP BY ALL",
)
def _(t):
    return evaluation.dataset_sizes(t.answers, long=True)


@query(
    "benchmark_as_items", "S22",
    """SELECT 'aime' AS dataset, 'train' AS split, row_number() OVER (ORDER BY item_id::VARCHAR) - 1 AS dataset_idx, item_id::VARCHAR AS ID, text, length(text)::VARCHAR AS target FROM benchmark""",
)
def _(t):
    df = t.benchmark.select(
        F.col("item_id").cast("string").alias("ID"), F.col("text").alias("Question"),
        F.char_length("text").cast("string").alias("Answer"),
    )
    return item_source.math_items(df)


# Every line item as a solution with three rated steps; the order is the problem.
@view(
    "solutions",
    """SELECT rid, dataset_idx AS problem, [d % 3 - 1, t % 3 - 1, q % 3 - 1] AS ratings, q % 7 <> 0 AS kept, q % 2 = 0 AS correct FROM answers""",
)
def solutions(t):
    step = lambda i, c: F.struct(
        F.array(F.struct(F.lit(f"step {i}").alias("text"), (F.col(c) % 3 - 1).alias("rating"))).alias("completions")
    )
    reason = F.when(F.col("q") % 7 == 0, "give_up").when(F.col("q") % 2 == 0, "solution").otherwise("found_error")
    raw = t.answers.select(
        F.col("rid").alias("dataset_idx"),
        F.struct(
            F.col("dataset_idx").cast("string").alias("problem"), F.col("d").cast("string").alias("ground_truth_answer"),
            F.lit("s").alias("ground_truth_solution"), F.col("t").cast("string").alias("pre_generated_answer"),
        ).alias("question"),
        F.struct(
            reason.alias("finish_reason"), F.array(step(0, "d"), step(1, "t"), step(2, "q")).alias("steps")
        ).alias("label"),
    )
    return rated_steps.solutions(raw)


@query(
    "rated_solutions", "S9 P50 F21",
    """SELECT rid AS dataset_idx, md5(problem::VARCHAR) AS problem_id, round(list_avg(ratings), 6) AS avg_rating, list_min(ratings) < 0 AS any_negative_rating,
              len(ratings)::INTEGER AS n_ratings, correct FROM solutions WHERE kept""",
)
def _(t):
    return rounded(
        t.solutions.select("dataset_idx", "problem_id", "avg_rating", "any_negative_rating", "n_ratings", "correct")
    )


@query(
    "hard_problems", "S23 A19 M2",
    """SELECT md5(problem::VARCHAR) AS problem_id, problem::VARCHAR AS text, count(DISTINCT rid) > 0 AS found FROM solutions WHERE kept
       GROUP BY ALL HAVING NOT bool_or(correct)""",
)
def _(t):
    hard = rated_steps.hard_problems(t.solutions)
    return hard.select("problem_id", "text", F.lit(True).alias("found")).distinct()


@query(
    "best_rated_solutions", "A45 A18",
    """SELECT count(*) AS n, round(avg(correct::INT), 6) AS correct FROM (
         SELECT correct, row_number() OVER (PARTITION BY problem ORDER BY round(list_avg(ratings), 9) DESC, rid) AS rn FROM solutions WHERE kept) WHERE rn = 1""",
)
def _(t):
    rows = t.solutions.withColumn("score", F.round("avg_rating", 9))
    best = selection.best_by_score(rows, ["problem_id"], tie=[F.col("dataset_idx")])
    return rounded(best.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("int")).alias("correct")))


# --- result files -------------------------------------------------------------------

def round_trip(df, name: str, kind: str):
    """Write a result file and read it back."""
    path = scratch_folder(df.sparkSession, name)
    submissions.write(df, path)
    return submissions.read(df.sparkSession, path, kind)


@query(
    "soft_label_file", "S10 S11 J6 F23",
    """SELECT dataset, split, dataset_idx, class_idx, round(avg(p), 6) AS prob FROM soft GROUP BY ALL""",
)
def _(t):
    """A file of every dataset and split, written and read back."""
    averaged = written(t.averaged.select(*ITEM, "pred"), "averaged")
    files = []
    for dataset, split in itertools.product(("CSC", "MP", "Paraphrase"), ("train", "dev")):
        preds = averaged.where((F.col("dataset") == dataset) & (F.col("split") == split))
        ordered = reshape.item_order(preds.select(*ITEM))
        table = joins.in_item_order(submissions.as_text(submissions.must_sum_to_one(preds)), ordered)
        back = round_trip(table, "soft-file", "array<double>")
        files.append(back.select(F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), "dataset_idx", "pred"))
    every = functools.reduce(DataFrame.unionByName, files)
    return every.select(*ITEM, F.posexplode_outer("pred").alias("class_idx", "prob")).select(
        *ITEM, "class_idx", r6("prob").alias("prob")
    )


@query(
    "all_result_files", "S25 S26 S27 S10 S11 F23",
    """WITH i AS (SELECT DISTINCT dataset, dataset_idx FROM answers WHERE split = 'train' AND dataset IN ('CSC', 'MP', 'Paraphrase')),
     v AS (SELECT *, row_number() OVER (PARTITION BY dataset, dataset_idx, run_idx ORDER BY rid) AS rn
           FROM parsed WHERE split = 'train' AND abs(list_sum(ps) - 1) < 0.01),
     x AS (SELECT dataset, dataset_idx, k.k AS pos, sum(coalesce(ps[list_position(ks, k.k)], 0)) AS s FROM v, range(11) k(k) WHERE rn = 1 AND k.k < n_classes GROUP BY ALL),
     y AS (SELECT *, s / sum(s) OVER (PARTITION BY dataset, dataset_idx) AS p FROM x),
     f AS (SELECT *, row_number() OVER (PARTITION BY dataset, dataset_idx, run_idx ORDER BY rid) AS rn FROM label_lists WHERE split = 'train'),
     g AS (SELECT *, row_number() OVER (PARTITION BY dataset, dataset_idx ORDER BY run_idx) AS first FROM f WHERE rn = 1 AND len(preds) = 3),
     h AS (SELECT dataset, dataset_idx, k.k AS pos, preds[k.k + 1] AS label FROM g, range(3) k(k) WHERE first = 1)
     SELECT i.dataset, 'soft-label' AS task, i.dataset_idx, pos::INTEGER AS pos, round(p, 6) AS value FROM i LEFT JOIN y USING (dataset, dataset_idx)
     UNION ALL SELECT i.dataset, 'perspectivist', i.dataset_idx, pos::INTEGER, label::DOUBLE FROM i LEFT JOIN h USING (dataset, dataset_idx)""",
)
def _(t):
    """The files of all datasets and tasks, checked, written, committed and read back."""
    of_split = F.col("split") == "train"
    items = t.answers.where(of_split & F.col("dataset").isin("CSC", "MP", "Paraphrase")).select(*ITEM).distinct()
    soft = submit.soft_label_table(t.responses.where(of_split), items, [F.col("rid")])
    three = F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("annotator_ids")
    raw = label_list_answers(t).where(of_split)
    lists = submit.perspectivist_table(raw, items.select(*ITEM, three), [F.col("rid")])
    tables = {"soft-label": written(soft, "soft"), "perspectivist": written(lists, "lists")}
    kinds = {"soft-label": "array<double>", "perspectivist": "array<int>"}
    folder = scratch_folder(t.spark, "results")
    wanted = list(itertools.product(("CSC", "MP", "Paraphrase"), kinds))
    submit.write_all({(dataset, task): tables[task] for dataset, task in wanted}, folder)
    back = [
        submit.read_one(t.spark, folder, dataset, task, kinds[task]).select(
            F.lit(dataset).alias("dataset"), F.lit(task).alias("task"), "dataset_idx", F.posexplode_outer("pred").alias("pos", "value")
        ).withColumn("value", r6(F.col("value").cast("double")))
        for dataset, task in wanted
    ]
    return functools.reduce(DataFrame.unionByName, back)


def label_list_answers(t):
    """Label lists as answers of one model."""
    return t.label_lists.select(
        *ITEM, "run_idx", "rid", F.to_json("pred").alias("response"), F.lit(True).alias("success"),
        F.lit("Qwen/Qwen3-32B").alias("model_id"), F.lit(33).alias("template_id"), F.lit("set2").alias("gen_kwargs"),
    )


@query(
    "soft_label_submission", "S20 S25 A7 F23 J6 P43",
    """WITH v AS (SELECT *, row_number() OVER (PARTITION BY dataset, split, dataset_idx, run_idx ORDER BY rid) AS rn
                  FROM parsed WHERE abs(list_sum(ps) - 1) < 0.01),
     x AS (SELECT dataset, split, dataset_idx, k.k AS class_idx, sum(coalesce(ps[list_position(ks, k.k)], 0)) AS s FROM v, range(11) k(k) WHERE rn = 1 AND k.k < n_classes GROUP BY ALL),
     y AS (SELECT *, s / sum(s) OVER (PARTITION BY dataset, split, dataset_idx) AS p FROM x)
     SELECT i.dataset, i.split, i.dataset_idx, class_idx, round(p, 6) AS prob FROM (SELECT DISTINCT dataset, split, dataset_idx FROM answers) i
     LEFT JOIN y USING (dataset, split, dataset_idx)""",
)
def _(t):
    items = t.answers.select(*ITEM).distinct()
    table = submit.soft_label_table(t.responses, items, [F.col("rid")])
    vector = F.from_json("pred", "array<double>")
    return table.select(*ITEM, F.posexplode_outer(vector).alias("class_idx", "prob")).select(
        *ITEM, "class_idx", r6("prob").alias("prob")
    )


@query(
    "label_submission_soft", "S24 S27 A5",
    """SELECT dataset, split, dataset_idx, k.k AS class_idx, round(count(*) FILTER (pred + off = k.k) / count(*)::DOUBLE, 6) AS prob
       FROM labelled, range(11) k(k) WHERE k.k < n_classes GROUP BY dataset, split, dataset_idx, k.k""",
)
def _(t):
    items = t.answers.select(*ITEM).distinct()
    table = submit.label_table(t.labelled, items, "soft-label")
    vector = F.from_json("pred", "array<double>")
    return table.select(*ITEM, F.posexplode_outer(vector).alias("class_idx", "prob")).select(
        *ITEM, "class_idx", r6("prob").alias("prob")
    )


@query(
    "label_submission_per_annotator", "S24 S27 J7 F24 A16",
    """SELECT dataset_idx, '[' || string_agg(pred::VARCHAR, ',' ORDER BY pos) || ']' AS pred FROM annotator_votes GROUP BY ALL""",
)
def _(t):
    return submit.label_table(t.annotator_votes, t.voted_items, "perspectivist").select("dataset_idx", "pred")


@query(
    "perspectivist_submission", "S26 J2 F14 W6 F24 F13",
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY dataset, split, dataset_idx, run_idx ORDER BY rid) AS rn FROM label_lists),
     x AS (SELECT *, row_number() OVER (PARTITION BY dataset, split, dataset_idx ORDER BY run_idx) AS first FROM f WHERE rn = 1 AND len(preds) = 3)
     SELECT i.dataset, i.split, i.dataset_idx, replace(preds::VARCHAR, ' ', '') AS pred FROM (SELECT DISTINCT dataset, split, dataset_idx FROM answers) i
     LEFT JOIN x ON i.dataset = x.dataset AND i.split = x.split AND i.dataset_idx = x.dataset_idx AND x.first = 1""",
)
def _(t):
    raw = label_list_answers(t)
    three = F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("annotator_ids")
    items = t.answers.select(*ITEM).distinct().select(*ITEM, three)
    return submit.perspectivist_table(raw, items, [F.col("rid")]).select(*ITEM, "pred")


@query(
    "item_targets", "S2 P5 P7 P9 P10 P12 P38",
    """SELECT dataset, split, rid, annotator::VARCHAR AS annotator, pred, 1::INTEGER AS n_annotators, n_classes FROM labelled""",
)
def _(t):
    rows = t.labelled.select(
        "dataset", "split", F.col("rid").alias("dataset_idx"),
        F.create_map(F.col("annotator").cast("string"), F.col("pred").cast("string")).alias("annotations"),
        F.create_map(F.lit("post"), F.lit("x")).alias("text"), F.lit("unused").alias("request_idx"),
    )
    df = item_source.load_items(rows, task="perspectivist")
    return df.select(
        "dataset", "split", F.col("dataset_idx").alias("rid"), F.col("annotator_ids")[0].alias("annotator"),
        F.col("target")[0].alias("pred"), "n_annotators", "n_classes",
    )


@query(
    "item_soft_targets", "S2 P5 P10 P12",
    """SELECT dataset, split, rid, class_idx, round(p, 6) AS prob FROM soft""",
)
def _(t):
    offset = F.when(F.col("dataset") == "Paraphrase", 5).otherwise(0)
    entries = F.transform("pred", lambda p, i: F.struct((i - offset).cast("string"), p))
    rows = t.soft.select(
        "dataset", "split", F.col("rid").alias("dataset_idx"), F.map_from_entries(entries).alias("soft_label"),
        F.create_map(F.lit("a"), F.lit("1")).alias("annotations"), F.lit(1).alias("n_annotators"),
    )
    df = item_source.load_items(rows)
    return df.select(
        "dataset", "split", F.col("dataset_idx").alias("rid"), F.posexplode_outer("target").alias("class_idx", "prob")
    ).select("dataset", "split", "rid", "class_idx", r6("prob").alias("prob"))


# --- stacking and exploding ---------------------------------------------------------

@query(
    "stacked_tables", "U1 U3 U7",
    """SELECT name, count(*) AS n, count(value)::BIGINT AS n_value, count(text)::BIGINT AS n_text FROM (
         SELECT 'events' AS name, value, NULL AS text FROM events UNION ALL SELECT 'documents', NULL, text FROM documents) GROUP BY ALL""",
)
def _(t):
    frames = {"events": t.events.select("value"), "documents": t.documents.select("text")}
    return reshape.named(frames).groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_value"), F.count("text").alias("n_text")
    )


@query(
    "evaluation_bundles", "U2 A28",
    """SELECT part, name, dataset, round(avg((pred = target)::INT), 6) AS correct, count(*) AS count FROM (
         SELECT split AS part, name, dataset, pred, target FROM eval_rows WHERE name <> 'simple') GROUP BY ALL""",
)
def _(t):
    rows = t.labelled.select(*ITEM, "target", "pred")
    bundles = []
    for part in ("train", "dev"):
        one = evaluation.evaluate(rows.where(F.col("split") == part), t.targets)
        one = {"accuracy": one["accuracy"], "f1": one["f1"]}
        bundles.append(evaluation.with_column(one, "part", part))
    kept = evaluation.only(evaluation.stack(*bundles), "name <> 'simple'")
    return rounded(kept["accuracy"].select("part", "name", "dataset", "correct", "count"))


@query(
    "persona_rows", "U4 J3 B8 B9",
    """SELECT l.split, l.rid, l.target::DOUBLE AS target, p.p AS kind, CASE p.p WHEN 'none' THEN 'Persona none: ' || d ELSE 'Persona ' || coalesce(a.nation, '?') || ': ' || d END AS prompt
       FROM labelled l JOIN annotators a ON l.annotator = a.suppkey, (SELECT unnest(['none', 'own']) AS p) p""",
)
def _(t):
    items = t.labelled.select(
        F.lit("all").alias("dataset"), "split", F.col("rid").alias("dataset_idx"),
        F.array(F.col("annotator").cast("string")).alias("annotator_ids"), F.array("target").alias("target"),
        F.create_map(F.lit("d"), F.col("d").cast("string")).alias("text"),
    )
    rows = batches.persona_rows(items, t.annotators, include_none=True)
    name = F.coalesce(F.try_element_at("metadata", F.lit("nation")), F.lit("?"))
    rows = rows.withColumns(
        {"kind": F.when(F.col("persona") == "none", "none").otherwise("own")}
    ).withColumn("persona", F.when(F.col("kind") == "none", "none").otherwise(name))
    out = batches.with_persona_prompt(rows, F.lit("Persona {persona}: {d}"), ["d"])
    return out.select("split", F.col("dataset_idx").alias("rid"), F.col("target").cast("double").alias("target"), "kind", "prompt")


@query(
    "unpivoted_labels", "U6",
    "SELECT dataset, split, rid, unnest(['d', 't', 'q']) AS name, unnest([d, t, q]) AS value FROM answers",
)
def _(t):
    return reshape.long_form(t.answers.select(*KEY, "d", "t", "q"), KEY, ["d", "t", "q"], "name", "value")


@query(
    "domains", "P49",
    "SELECT 'other' AS domain, count(*) AS n FROM answers",
)
def _(t):
    return reshape.label_domain(t.answers).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query(
    "progress_report", "B10 P53 J12 A23 A24",
    """WITH v AS (SELECT dataset, split, template_id, model_id, gen_kwargs, avg((abs(list_sum(ps) - 1) < 0.01)::INT) AS ok, count(*) AS n FROM parsed GROUP BY ALL),
     c AS (SELECT p.dataset, p.split, p.template_id, p.model_id, p.gen_kwargs, p.rid, sum(coalesce(ps[list_position(ks, k.class_idx)], 0) / list_sum(ps) - k.target) OVER (PARTITION BY p.dataset, p.split, p.rid ORDER BY k.class_idx) AS gap
           FROM parsed p JOIN targets k ON p.dataset = k.dataset AND p.split = k.split AND p.dataset_idx = k.dataset_idx WHERE abs(list_sum(ps) - 1) < 0.01),
     l AS (SELECT dataset, split, template_id, model_id, gen_kwargs, rid, sum(abs(gap)) AS ws FROM c GROUP BY ALL),
     m AS (SELECT dataset, split, template_id, model_id, gen_kwargs, avg(ws) AS ws, count(*) AS n FROM l GROUP BY ALL)
     SELECT v.dataset, v.split, v.template_id, CASE v.model_id WHEN 'Qwen/Qwen3-32B' THEN '32.0' ELSE '14.0' END AS model_size, v.model_id,
            CASE v.gen_kwargs WHEN 'thinking' THEN 'set1' ELSE v.gen_kwargs END AS gen_kwargs, round(v.ok, 6) AS is_valid_pred, v.n AS validity_count,
            round(m.ws, 6) AS avg_ws_loss, m.n AS loss_count
     FROM v LEFT JOIN m USING (dataset, split, template_id, model_id, gen_kwargs)""",
)
def _(t):
    items = t.targets.withColumn("category", F.lit(""))
    return rounded(reports.progress(t.responses, items, with_steps=False))


@query(
    "label_baselines", "A10 P34",
    """WITH s AS (SELECT dataset, split, dataset_idx, list_avg(list_transform(range(1, len(preds) + 1), lambda i: abs(preds[i] - targets[i])::DOUBLE)) / (n_classes - 1) AS x
                  FROM label_lists WHERE len(preds) = len(targets)),
     o AS (SELECT dataset, split, dataset_idx, min(x) AS x FROM s GROUP BY ALL)
     SELECT 'Simple Sampling' AS method, dataset, round(avg(x), 6) AS avg_abs_dist FROM s GROUP BY ALL
     UNION ALL SELECT 'BoN Oracle', dataset, round(avg(x), 6) FROM o GROUP BY ALL""",
)
def _(t):
    # The target differs between the answers, so it stays with the answer.
    joined = metrics.with_metrics(t.label_lists, "perspectivist")
    best = reports.best_answers(joined.select(*ITEM, "run_idx", "avg_abs_dist"), "avg_abs_dist")
    rows = reshape.named(
        {"Simple Sampling": joined.select("dataset", "avg_abs_dist"), "BoN Oracle": best.select("dataset", "avg_abs_dist")},
        "method",
    )
    return rounded(rows.groupBy("method", "dataset").agg(F.avg("avg_abs_dist").alias("avg_abs_dist")))

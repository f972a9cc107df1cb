"""Readers, writers, result files, request tables and streams on small fixtures."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from dissensus import schemas
from dissensus.operators import batches, cleaning, diversity, reshape
from dissensus.plans import reports, submit
from dissensus.schemas import ITEM
from dissensus.sources import answers, items, logs, rated_steps, submissions
from dissensus.streaming import reports as streams


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


RAW_ITEMS = {
    "7": {
        "text": {"post": "p", "reply": "r"}, "soft_label": {"0.0": 0.25, "1.0": 0.75},
        "annotations": {"Ann1": "1", "Ann2": "0"}, "number of annotators": 2, "number of annotations": 2,
    },
    "9": {
        "text": {"post": "q", "reply": "s"}, "soft_label": {"0.0": 1.0, "1.0": 0.0},
        "annotations": {"Ann2": "0"}, "number of annotators": 1, "number of annotations": 1,
    },
}


def mp_items(spark, folder):
    with open(f"{folder}/MP_dev.json", "w") as f:
        json.dump(RAW_ITEMS, f, indent=1)
    df = items.read_keyed_json(spark, f"{folder}/MP_dev.json")
    return df.withColumns({"dataset": F.lit("MP"), "split": F.lit("dev")})


def test_keyed_json_items(spark, folder):
    raw = mp_items(spark, folder)
    with open(f"{folder}/meta.json", "w") as f:
        json.dump({"1": {"Gender": "x"}}, f)
    people = items.read_annotators(spark, f"{folder}/meta.json", "MP")
    soft = {r["dataset_idx"]: r for r in items.load_items(raw, people).collect()}
    assert soft[7]["target"] == [0.25, 0.75] and not soft[7]["tgt_has_holes"]
    assert soft[7]["annotator_metadata"][0] == {"Gender": "x"} and soft[7]["n_annotations"] == 2
    labels = {r["dataset_idx"]: r for r in items.load_items(raw, task="perspectivist").collect()}
    assert labels[7]["target"] == [1, 0] and labels[7]["annotator_ids"] == ["Ann1", "Ann2"]
    assert labels[9]["n_annotators"] == 1
    assert "target" not in items.load_items(raw, task=None).columns


def test_items_with_categories(spark):
    df = spark.sql(
        """SELECT 'VariErrNLI' AS dataset, 'dev' AS split, 1L AS dataset_idx, map('a', map('0', 1.0D, '1', 0.0D)) AS soft_label,
                  map('Ann1', 'entailment,neutral', 'Ann2', 'contradiction') AS annotations"""
    )
    out = {r["category"]: r["target"] for r in items.label_targets(cleaning.with_classes(df)).collect()}
    assert out == {"entailment": [1, 0], "neutral": [1, 0], "contradiction": [0, 1]}
    soft = items.soft_targets(df).first()
    assert soft["category"] == "a" and soft["target"] == [1.0, 0.0]


def test_converted_items_keep_their_partitions(spark, folder):
    mp_items(spark, folder)
    items.convert_keyed_json(spark, f"{folder}/MP_dev.json", f"{folder}/items", "MP", "dev")
    df = items.read_items(spark, f"{folder}/items", ["MP"], ["dev"])
    assert df.count() == 2
    assert "PartitionFilters: [isnotnull" in df._jdf.queryExecution().executedPlan().toString()


def test_answer_files(spark, folder):
    rows = [(1, 0, "MP", "dev", "a", True), (1, 1, "MP", "dev", "b", False)]
    df = spark.createDataFrame(rows, "dataset_idx bigint, run_idx int, dataset string, split string, response string, success boolean")
    answers.append_answers(df, f"{folder}/x/y")
    answers.append_answers(df.where("run_idx = 0"), f"{folder}/x/y")
    back = answers.read_json_lines(spark, folder, "*.json")
    assert back.count() == 3 and back.where("timestamp IS NULL").count() == 0
    answers.gather_to_parquet(spark, f"{folder}/x", f"{folder}/none")  # no file of the expected name
    answers.json_to_parquet(spark, f"{folder}/x/y", f"{folder}/p")
    assert answers.read_folder(spark, f"{folder}/p").count() == 3


def test_rated_steps(spark, folder):
    def row(reason, ratings):
        return {
            "question": {"problem": "1+1", "ground_truth_answer": "2", "ground_truth_solution": "s", "pre_generated_answer": "2"},
            "label": {"finish_reason": reason, "steps": [{"completions": [{"text": "t", "rating": r}]} for r in ratings]},
        }

    with open(f"{folder}/phase.jsonl", "w") as f:
        for r in (row("solution", [1, 0]), row("found_error", [1, -1]), row("give_up", [1])):
            f.write(json.dumps(r) + "\n")
    out = {r["correct"]: r for r in rated_steps.solutions(rated_steps.read(spark, f"{folder}/phase.jsonl")).collect()}
    assert len(out) == 2 and out[True]["avg_rating"] == 0.5 and out[False]["any_negative_rating"]
    assert out[True]["dataset_idx"] != out[False]["dataset_idx"] and out[True]["problem_id"] == out[False]["problem_id"]


def test_batch_service_file(spark, folder):
    parts = [{"text": "why", "thought": True}, {"text": "answer"}]
    lines = [
        {"dataset_idx": 1, "status": "", "request": "x", "response": {"candidates": [{"finishReason": "STOP", "content": {"parts": parts}}]}},
        {"dataset_idx": 2, "status": "", "request": "x", "response": {"candidates": [{"finishReason": "MAX_TOKENS", "content": {"parts": []}}]}},
    ]
    with open(f"{folder}/predictions.jsonl", "w") as f:
        f.writelines(json.dumps(x) + "\n" for x in lines)
    answers.convert_batch_service(spark, f"{folder}/predictions.jsonl", f"{folder}/out")
    out = {r["dataset_idx"]: r for r in spark.read.schema(schemas.PREDICTIONS).json(f"{folder}/out").collect()}
    assert (out[1]["reasoning"], out[1]["response"], out[1]["success"]) == ("why", "answer", True)
    assert out[2]["response"] is None and not out[2]["success"]


LOG = (
    "INFO 07-01 10:00:0{i} [loggers.py:1] Engine 000: Avg prompt throughput: {a} tokens/s, Avg generation throughput: 5.5 tokens/s, "
    "Running: 3 reqs, Waiting: 1 reqs, GPU KV cache usage: 1.5%, Prefix cache hit rate: 20.0%"
)


def test_throughput_log(spark, folder):
    with open(f"{folder}/server.log", "w") as f:
        f.write("start model='org/name' ready\nmodel='other'\n")
        f.writelines(LOG.format(i=i, a=10.5 + i) + "\n" for i in range(3))
    lines = logs.read_lines(spark, f"{folder}/server.log")
    out = logs.throughput(lines).orderBy("timestamp").collect()
    assert [r["prompt_throughput"] for r in out] == [10.5, 11.5, 12.5]
    assert out[0]["running_requests"] == 3 and out[0]["prefix_cache_hit_rate"] == 20.0
    assert logs.model_names(lines).first()["model"] == "org/name"
    stream = streams.log_stream(spark, folder)
    table = streams.run_to_table(stream, "log")
    assert table.count() == 3


def test_result_file_formats(spark, folder):
    kinds = {
        "[1, 1, 1, 1]": "array<int>",
        "[0.115625, 0.109375]": "array<double>",
        "[[0, 0], [0, 0], [1, 0]]": "array<array<int>>",
        "[[0.805, 0.195], [0.7, 0.3], [0.4, 0.6]]": "array<array<double>>",
    }
    for i, (line, kind) in enumerate(kinds.items()):
        with open(f"{folder}/f{i}.tsv", "w") as f:
            f.write(f"5\t{line}\n")
        row = submissions.read(spark, f"{folder}/f{i}.tsv", kind).first()
        assert row["dataset_idx"] == 5 and row["pred"] == json.loads(line)
    df = spark.createDataFrame([(i, "[%d.0,0.5]" % i, 100 - i) for i in range(50)], "dataset_idx bigint, pred string, ord int")
    submissions.write(df, f"{folder}/out")
    import glob

    lines = [x for p in sorted(glob.glob(f"{folder}/out/part-*")) for x in open(p).read().splitlines()]
    assert lines[0] == "49\t[49.0,0.5]" and [int(x.split("\t")[0]) for x in lines] == list(range(49, -1, -1))
    assert submissions.file_name("Paraphrase", "soft-label") == "par_test_soft.tsv"


def test_gates(spark):
    bad = spark.createDataFrame([("MP", "dev", 1, [0.5, 0.6])], "dataset string, split string, dataset_idx bigint, pred array<double>")
    with pytest.raises(submissions.InvalidSubmission):
        submissions.require_sum_to_one(bad)
    its = spark.createDataFrame([("MP", "dev", 1, ["a"])], "dataset string, split string, dataset_idx bigint, annotator_ids array<string>")
    with pytest.raises(submissions.InvalidSubmission):
        submissions.require_annotators(bad, its)
    with pytest.raises(Exception, match="does not sum to 1"):
        submissions.must_sum_to_one(bad).collect()
    with pytest.raises(Exception, match="another number of annotators"):
        submissions.must_have_annotators(bad.withColumn("pred", F.array(F.lit(1), F.lit(0))), its).collect()
    check = submissions.row_check(bad.withColumn("run_idx", F.lit(0)), its, runs=1).first()
    assert (check["expected"], check["found"], check["off"]) == (1, 1, False)


def test_category_submission(spark):
    rows = [("VariErrNLI", "test_clear", 1, c, [x, 1 - x]) for c, x in (("entailment", 0.25), ("neutral", 0.5), ("contradiction", 1.0))]
    df = spark.createDataFrame(rows, "dataset string, split string, dataset_idx bigint, category string, pred array<double>")
    text = submissions.as_text(df).first()["pred"]
    assert json.loads(text) == [[1.0, 0.0], [0.25, 0.75], [0.5, 0.5]]


def answer_rows(spark, rows):
    full = [("MP", "test_clear", i, run, "Qwen/Qwen3-32B", 31, "set2", r, True) for i, run, r in rows]
    return spark.createDataFrame(
        full,
        "dataset string, split string, dataset_idx bigint, run_idx int, model_id string, template_id int, gen_kwargs string, response string, success boolean",
    )


def test_submissions(spark):
    its = spark.createDataFrame(
        [("MP", "test_clear", 2, ["a", "b"], 0), ("MP", "test_clear", 1, ["a"], 1), ("MP", "test_clear", 3, ["a"], 2)],
        "dataset string, split string, dataset_idx bigint, annotator_ids array<string>, ord bigint",
    )
    raw = answer_rows(
        spark,
        [(1, 0, '{"0": 0.25, "1": 0.75}'), (1, 1, '{"0": 0.75, "1": 0.25}'), (2, 0, "bad"), (2, 0, '{"0": 1, "1": 0}')],
    )
    soft = [(r["dataset_idx"], r["pred"]) for r in submit.soft_label_table(raw, its).collect()]
    assert soft == [(2, "[1.0,0.0]"), (1, "[0.5,0.5]"), (3, None)]
    raw = answer_rows(spark, [(1, 0, "[1, 1]"), (1, 1, "[0]"), (2, 0, "[1, 0]")])
    labels = [(r["dataset_idx"], r["pred"]) for r in submit.perspectivist_table(raw, its).collect()]
    assert labels == [(2, "[1,0]"), (1, "[0]"), (3, None)]


def diversity_answers(spark):
    second = {1: (1, 0), 4: (0.49, 0.51), 8: (0.48, 0.52), 10: (0.47, 0.53), 11: (0.46, 0.54)}
    rows = []
    for i, (a, b) in second.items():
        first = "{'0': 0, '1': 1}" if i == 1 else "{'0': 0.5, '1': 0.5}"
        rows += [(i, 0, first), (i, 1, "{'0': %s, '1': %s}" % (a, b))]
    return answer_rows(spark, rows)


def test_judge_requests_of_diverse_items(spark):
    raw = diversity_answers(spark).withColumns({"reasoning": F.lit(""), "text": F.lit("t")})
    args = dict(kind="reformat", template="{problem}{response}", n_items=100, n_runs=5)
    assert batches.judge_requests(raw, **args).count() == 10
    by_item = diversity.by_problem(cleaning.clean(raw, discard_invalid=True), ITEM)
    out = batches.judge_requests(raw, diversity=by_item, **args).collect()
    assert {(r["dataset_idx"], r["run_idx"]) for r in out} == {(1, 0), (1, 1)}
    done = raw.where("dataset_idx = 1 AND run_idx = 0")
    left = batches.judge_requests(raw, done=done, **args)
    assert left.count() == 9
    shards = [batches.judge_requests(raw, rank=k, world=3, **args).count() for k in range(3)]
    assert sorted(shards) == [3, 3, 4]


def test_progress_report(spark):
    raw = diversity_answers(spark)
    its = spark.createDataFrame(
        [("MP", "test_clear", i, 2, "", [0.5, 0.5]) for i in (1, 4, 8, 10, 11)],
        "dataset string, split string, dataset_idx bigint, n_classes int, category string, target array<double>",
    )
    row = reports.progress(raw, its, with_steps=False).first()
    assert row["is_valid_pred"] == 1 and row["validity_count"] == 10 and row["loss_count"] == 10
    assert row["avg_ws_loss"] == pytest.approx((0.5 + 0.5 + 0.01 + 0.02 + 0.03 + 0.04) / 10)


def test_persona_rows_keep_their_own_prompt(spark):
    its = spark.createDataFrame(
        [("MP", "dev", 1, ["Ann1", "Ann2"], [0, 1], {"post": "p"})],
        "dataset string, split string, dataset_idx bigint, annotator_ids array<string>, target array<int>, text map<string,string>",
    )
    people = spark.createDataFrame([("MP", "1", {"age": "30"})], schemas.ANNOTATORS)
    rows = batches.persona_rows(its, people, include_none=True)
    out = batches.with_persona_prompt(rows, F.lit("{post}: {persona}"), ["post"]).collect()
    assert len(out) == 4
    own = {(r["annotator_id"], r["persona"] == "none"): r["prompt"] for r in out}
    assert json.loads(own["Ann1", False][3:]) == {"age": "30"} and own["Ann1", True] == "p: none"
    assert json.loads(own["Ann2", False][3:]) == {"data": "there is no information about the annotator"}
    pairs = batches.training_pairs(batches.with_persona_prompt(rows, F.lit("{persona}"), []))
    assert pairs.dtypes == [("prompt", "string"), ("target", "double")]
    up = batches.persona_rows(its, people, upsample_by="annotator_id")
    assert up.count() == 2


def test_prediction_requests(spark):
    its = spark.createDataFrame(
        [("MP", "dev", i, f"text {i}", {"0": 1 / 3, "1": 2 / 3}) for i in range(10)],
        "dataset string, split string, dataset_idx bigint, text string, soft_label map<string,double>",
    )
    templates = spark.createDataFrame([("MP", 31, "rate {text}")], "dataset string, template_id int, template string")
    out = batches.prediction_requests(its, templates, n_loops=2, n_examples=5, n_fewshot=1, settings={"model_id": "m"})
    rows = out.collect()
    assert len(rows) == 10 and {r["dataset_idx"] for r in rows} == {1, 2, 3, 4, 5}
    convo = rows[0]["convo"]
    assert [m["role"] for m in convo] == ["user", "assistant", "user"]
    assert json.loads(convo[1]["content"]) == {"0": 0.333, "1": 0.667} and rows[0]["model_id"] == "m"


def test_stream_over_many_files_equals_batch(spark, sf_dir, folder):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("timestamp", F.col("ts").cast("timestamp"))
    flat = events.select("event_type", "timestamp", "value").repartitionByRange(4, "timestamp")
    flat.sortWithinPartitions("timestamp").write.parquet(f"{folder}/events")
    stream = streams.file_stream(spark, f"{folder}/events", flat.schema, max_files=1)
    shaped = lambda df: df.select("event_type", (F.col("value") > 20).alias("is_valid_pred"), F.col("value").alias("ws_loss"))
    table = streams.run_to_table(streams.progress(shaped(stream), ["event_type"]), "p", "update", ["event_type"])
    batch = streams.progress(shaped(flat), ["event_type"])
    key = lambda df: sorted((r["event_type"], r["validity_count"], round(r["avg_ws_loss"], 9)) for r in df.collect())
    assert key(table) == key(batch)
    repeated = reshape.stacked(flat, flat)
    repeated.write.parquet(f"{folder}/twice")
    twice = streams.file_stream(spark, f"{folder}/twice", flat.schema)
    kept = streams.run_to_table(streams.distinct_answers(twice, ["event_type", "timestamp"], delay="60 days"), "d")
    assert kept.count() == flat.dropDuplicates(["event_type", "timestamp"]).count()


def test_a_subset_does_not_sort_the_answers(spark):
    from dissensus.sources import answers

    df = spark.createDataFrame([(i % 5 or None, i) for i in range(20)], "dataset_idx long, x int")
    ids = spark.createDataFrame([(1,), (1,), (3,), (None,)], "dataset_idx long")
    out = answers.subset(df, ids)
    assert sorted(r["x"] for r in out.collect()) == [1, 3, 6, 8, 11, 13, 16, 18]
    assert "ShuffledHashJoin" in out._jdf.queryExecution().executedPlan().toString()

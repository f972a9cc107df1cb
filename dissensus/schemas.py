"""Explicit schemas of every input, so that no read has to infer one."""

from __future__ import annotations

# The key of an item, and of one answer to it.
ITEM = ["dataset", "split", "dataset_idx"]
ANSWER = [*ITEM, "run_idx"]

# What tells one set of repeated answers to an item from another.
EXAMPLE = [
    "template_id",
    "template_alias",
    "model_id",
    "model_size",
    "gen_kwargs",
    "dataset",
    "n_classes",
    "split",
    "dataset_idx",
]

RAW_ITEM = (
    "text map<string,string>, soft_label map<string,double>, annotations map<string,string>, "
    "`number of annotators` int, `number of annotations` int"
)

RAW_MATH_ITEM = "text string, target string"

# Items whose soft label is one distribution per category.
RAW_ITEM_BY_CATEGORY = (
    "text map<string,string>, soft_label map<string,map<string,double>>, "
    "annotations map<string,string>, `number of annotators` int, `number of annotations` int"
)

PREDICTIONS = (
    "dataset_idx bigint, run_idx int, model_id string, template_id int, gen_kwargs string, "
    "dataset string, split string, response string, reasoning string, success boolean, "
    "max_tokens int, n_input_tokens int, n_output_tokens int, run_start timestamp, "
    "timestamp timestamp, error string, prompt string"
)

JUDGEMENTS = (
    PREDICTIONS + ", judge_model_id string, judge_gen_kwargs string, judge_template_id int"
)

RATED_STEPS = "array<struct<idx:int,rating:string>>"

STEP_RATED = (
    "question struct<problem:string,ground_truth_answer:string,ground_truth_solution:string,"
    "pre_generated_answer:string>, "
    "label struct<finish_reason:string,steps:array<struct<completions:"
    "array<struct<text:string,rating:int>>>>>"
)

MATH_ITEMS = "ID string, Question string, Answer string"

BATCH_RESPONSES = (
    "dataset_idx bigint, run_idx int, model_id string, template_id int, gen_kwargs string, "
    "dataset string, split string, status string, processed_time string, request string, "
    "response struct<candidates:array<struct<finishReason:string,content:struct<"
    "parts:array<struct<text:string,thought:boolean>>>>>>"
)

ANNOTATOR_PREDICTIONS = (
    "dataset string, split string, dataset_idx bigint, annotator_ids string, pred int, target int"
)

ANNOTATORS = "dataset string, annotator_id string, attrs map<string,string>"

SUBMISSION = "dataset_idx bigint, pred string"

"""Request tables and prompts over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dissensus.functions import prompts, text
from dissensus.operators import batches, diversity, ordering
from dissensus.session import written
from workloads import columns, joining, reductions  # noqa: F401  (their views are used)
from workloads.base import query, view

ITEM = ["dataset", "split", "dataset_idx"]


# Conversations as items: the turn is the run, an assistant's text the reasoning.
@view(
    "dialogs",
    """SELECT conv_id, turn, role, text, turn % 2 = 0 AS readable FROM conversations""",
)
def dialogs(t):
    steps = F.to_json(F.array("role", "text"))
    final = F.concat(F.lit("answer "), F.col("turn"))
    good = F.concat(F.lit('{"steps": '), steps, F.lit(', "final_response": "'), final, F.lit('"}'))
    return t.conversations.select(
        F.lit("all").alias("dataset"), F.lit("all").alias("split"), F.col("conv_id").alias("dataset_idx"),
        F.col("turn").cast("int").alias("run_idx"), F.col("role").alias("text"),
        F.col("text").alias("reasoning"),
        F.when(F.col("turn") % 2 == 0, good).otherwise("no json here").alias("response"),
        F.concat(F.lit("target "), F.col("turn")).alias("target"),
    )


def keys():
    return F.col("dataset_idx").alias("conv_id"), F.col("run_idx").cast("bigint").alias("turn")


@query(
    "item_prompts", "B1 B6",
    """SELECT conv_id, turn, 'Task' || k.k || ' {' || 'x' || '}: ' || text AS prompt FROM conversations, (SELECT unnest([31, 60]) AS k) k""",
)
def _(t):
    templates = t.spark.createDataFrame(
        [("all", 31, "Task31 {{x}}: {text}"), ("all", 60, "Task60 {{x}}: {text}")],
        "dataset string, template_id int, template string",
    )
    df = t.dialogs.withColumns({"text": F.col("reasoning"), "template_id": F.explode(F.array(F.lit(31), F.lit(60)))})
    return batches.with_prompt(df, templates).select(*keys(), "prompt")


@query(
    "metadata_prompts", "B2",
    """SELECT s_suppkey, 'About {"nation":"' || n_name || '"}' AS prompt FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def _(t):
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.lit("all").alias("dataset"), F.lit(33).alias("template_id"), F.lit("x").alias("text"),
        F.create_map(F.lit("nation"), "n_name").alias("annotator_metadata"),
    )
    templates = t.spark.createDataFrame(
        [("all", 33, "About {annotator_metadata}")], "dataset string, template_id int, template string"
    )
    out = batches.with_prompt(rows, templates)
    # Compared without the white space of the indented JSON.
    return out.select("s_suppkey", F.regexp_replace("prompt", r"\s*([{}:])\s*", "$1").alias("prompt")).select(
        "s_suppkey", F.replace("prompt", F.lit("About{"), F.lit("About {")).alias("prompt")
    )


@query(
    "judge_prompts_sentences", "B3 P40",
    """WITH s AS (SELECT conv_id, turn, role, string_split(regexp_replace(regexp_replace(text, '^ +| +$', '', 'g'), '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM conversations),
     f AS (SELECT conv_id, turn, role, list_filter(parts, lambda x: regexp_matches(x, '\\S')) AS parts FROM s)
     SELECT conv_id, turn, len(parts)::INTEGER AS n, role AS problem, parts[len(parts)] AS last FROM f""",
)
def _(t):
    out = batches.with_judge_prompt(t.dialogs, "sentences", "{PROBLEM}@@{STEPS}")
    pieces = F.split("judge_prompt", "@@")
    steps = F.from_json(pieces[1], "array<struct<text:string>>")
    return out.select(
        *keys(), F.size(steps).alias("n"), pieces[0].alias("problem"), F.element_at(steps, -1)["text"].alias("last")
    )


@query(
    "judge_prompts_paragraphs", "B3 P41",
    """SELECT conv_id, turn, 1::INTEGER AS n, 0::INTEGER AS idx, text AS step FROM conversations""",
)
def _(t):
    out = batches.with_judge_prompt(t.dialogs, "paragraphs", "{PROBLEM}@@{STEPS}@@{FINAL_RESPONSE}")
    steps = F.from_json(F.split("judge_prompt", "@@")[1], "array<struct<idx:int,text:string>>")
    return out.select(*keys(), F.size(steps).alias("n"), steps[0]["idx"].alias("idx"), steps[0]["text"].alias("step"))


@query(
    "judge_prompts_answer_steps", "B3 B4 P15",
    """SELECT conv_id, turn, role AS problem, 2::INTEGER AS n, text AS step, 'answer ' || turn AS final FROM dialogs WHERE readable""",
)
def _(t):
    out = batches.with_judge_prompt(t.dialogs, "answer_steps", "{PROBLEM}@@{STEPS}@@{FINAL_RESPONSE}")
    pieces = F.split("judge_prompt", "@@")
    steps = F.from_json(pieces[1], "array<struct<idx:int,step:string>>")
    return out.where(F.col("judge_prompt").isNotNull()).select(
        *keys(), pieces[0].alias("problem"), F.size(steps).alias("n"), steps[1]["step"].alias("step"), pieces[2].alias("final")
    )


@query(
    "judge_prompts_whole_text", "B3",
    """SELECT conv_id, turn, k.k AS kind, CASE k.k
         WHEN 'outcome' THEN role || '|' || E'\\n<think>\\n' || text || E'\\n</think>\\n\\n' || (CASE WHEN readable THEN 'r' ELSE 'no json here' END) || E'\\n'
         WHEN 'reformat' THEN role || '|' || text
         WHEN 'verify' THEN role || '|target ' || turn || '|answer ' || turn
         ELSE role || '|' || trim(text) || '|answer ' || turn END AS prompt
       FROM dialogs, (SELECT unnest(['outcome', 'reformat', 'verify', 'annotators']) AS k) k WHERE readable OR k.k IN ('outcome', 'reformat')""",
)
def _(t):
    df = t.dialogs
    templates = {
        "outcome": "{llm_problem}|{llm_solution}",
        "reformat": "{problem}|{response}",
        "verify": "{problem}|{reference_solution}|{solution}",
        "annotators": "{PROBLEM}|{REASONING}|{FINAL_RESPONSE}",
    }
    short = df.withColumn("response", F.when(F.col("run_idx") % 2 == 0, "r").otherwise(F.col("response")))
    kinds = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                batches.judge_prompt(kind, F.lit(template), df, F.col("text")).alias("prompt"),
            )
            for kind, template in templates.items()
            if kind != "outcome"
        ]
    )
    outcome = short.select(
        *keys(), F.lit("outcome").alias("kind"),
        batches.judge_prompt("outcome", F.lit(templates["outcome"]), short, F.col("text")).alias("prompt"),
    )
    return df.select(*keys(), F.inline(kinds)).where(F.col("prompt").isNotNull()).unionByName(outcome)


@query(
    "answers_without_prompt", "B4",
    "SELECT conv_id, turn, 'response not readable' AS reason FROM dialogs WHERE NOT readable",
)
def _(t):
    out = batches.with_judge_prompt(t.dialogs, "answer_steps", "{PROBLEM}{STEPS}{FINAL_RESPONSE}")
    return batches.without_prompt(out).select(*keys(), "reason")


@query(
    "solutions_per_item", "A29",
    """SELECT conv_id, (r // 3)::INTEGER AS part, string_agg(role || ':' || length(text), ',' ORDER BY r) AS solutions FROM (
         SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r FROM conversations) GROUP BY ALL""",
)
def _(t):
    df = t.dialogs.withColumns({"model_id": F.col("text"), "response": F.lit("x")})
    lists = batches.solutions_per_item(df, 3)
    shown = F.transform(
        "solutions", lambda s: F.concat(s["model_id"], F.lit(":"), F.char_length(s["reasoning"]))
    )
    return lists.select(F.col("dataset_idx").alias("conv_id"), "part", F.array_join(shown, ",").alias("solutions"))


@query(
    "ranking_requests", "B3 B7 A29",
    """SELECT conv_id, count(*) AS n, min(role) AS problem FROM (
         SELECT conv_id, arg_min(role, turn) AS role, unnest(list(turn)) AS turn FROM conversations GROUP BY conv_id) GROUP BY conv_id""",
)
def _(t):
    first = ordering.first_rows(t.dialogs, ITEM, [F.col("run_idx")]).select(*ITEM, F.col("text").alias("topic"))
    rows = t.dialogs.join(first, ITEM).withColumns({"text": F.col("topic"), "success": F.lit(True)}).drop("topic", "target")
    out = batches.judge_requests(
        rows, "ranking", "{llm_problem}@@{llm_solutions}", n_items=None, n_runs=None, per_request=1000
    )
    pieces = F.split("judge_prompt", "@@")
    listed = F.from_json(pieces[1], "array<struct<run_idx:int>>")
    return out.select(
        F.col("dataset_idx").alias("conv_id"), F.size(listed).cast("bigint").alias("n"), pieces[0].alias("problem")
    )


@query(
    "conversations_with_examples", "B5 B6 M1",
    """WITH i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents)
       SELECT lang, doc_id, run.r::INTEGER AS run_idx, 5::INTEGER AS n_messages, 'Rate: ' || text AS prompt,
              (SELECT 'Rate: ' || text FROM i f WHERE f.lang = i.lang AND f.pos = 0) AS first_message, '{"0":0.333,"1":0.667}' AS first_answer
       FROM i, range(2) run(r) WHERE pos >= 2""",
)
def _(t):
    items = t.documents.select(
        F.col("lang").alias("dataset"), F.lit("all").alias("split"), F.col("doc_id").alias("dataset_idx"), "text",
        F.create_map(F.lit("0"), F.lit(1 / 3), F.lit("1"), F.lit(2 / 3)).alias("soft_label"),
    )
    templates = t.documents.select(F.col("lang").alias("dataset")).distinct().select(
        "dataset", F.lit(31).alias("template_id"), F.lit("Rate: {text}").alias("template")
    )
    out = batches.prediction_requests(items, templates, n_loops=2, n_fewshot=2)
    return out.select(
        F.col("dataset").alias("lang"), F.col("dataset_idx").alias("doc_id"), "run_idx",
        F.size("convo").alias("n_messages"), F.element_at("convo", -1)["content"].alias("prompt"),
        F.col("convo")[0]["content"].alias("first_message"), F.col("convo")[1]["content"].alias("first_answer"),
    )


@query(
    "open_requests", "B6 J4",
    """SELECT o_orderkey AS dataset_idx, r.r::INTEGER AS run_idx, 'Order ' || o_orderkey AS prompt FROM orders, range(3) r(r)
       WHERE NOT EXISTS (SELECT 1 FROM answers a WHERE a.dataset_idx = o_orderkey AND a.run_idx = r.r AND a.q > 10)""",
)
def _(t):
    fixed = {"dataset": F.lit("all"), "split": F.lit("all")}
    items = t.orders.select(F.col("o_orderkey").alias("dataset_idx"), F.col("o_orderkey").cast("string").alias("text"))
    done = t.answers.withColumns({**fixed, "template_id": F.lit(31), "success": F.col("q") > 10})
    templates = t.spark.createDataFrame(
        [("all", 31, "Order {text}")], "dataset string, template_id int, template string"
    )
    out = batches.prediction_requests(items.withColumns(fixed), templates, n_loops=3, done=done)
    return out.select("dataset_idx", "run_idx", "prompt")


@query(
    "diverse_judge_requests", "B7 A22 F19 F17",
    """WITH v AS (SELECT dataset, split, dataset_idx, round(pairwise, 9) AS v FROM spread), e AS (SELECT quantile_cont(v, 0.8) AS q FROM v),
     a AS (SELECT s.* FROM answers s JOIN v USING (dataset, split, dataset_idx), e WHERE v.v > e.q AND model_id = 'Qwen/Qwen3-32B')
     SELECT dataset, split, dataset_idx, run_idx, count(*) AS n, max('judge ' || d) AS prompt FROM a GROUP BY ALL""",
)
def _(t):
    value = written(t.spread.withColumn("avg_pairwise_ws_loss", F.round("avg_pairwise_ws_loss", 9)), "spread")
    rows = t.answers.select(
        *ITEM, "run_idx", "model_id", "rid", F.lit(True).alias("success"), F.col("d").cast("string").alias("reasoning"),
        F.lit("x").alias("text"), F.lit("y").alias("response"),
    )
    out = batches.judge_requests(
        rows, "reformat", "judge {response}", n_items=None, n_runs=None, spec={"model_id": "Qwen/Qwen3-32B"},
        diversity=diversity.with_quintile(value),
    )
    return out.groupBy(*ITEM, "run_idx").agg(F.count(F.lit(1)).alias("n"), F.max("judge_prompt").alias("prompt"))


@query(
    "open_judge_requests", "B7 J4",
    """SELECT conv_id, turn, 3::INTEGER AS n_messages FROM conversations WHERE turn % 3 <> 0""",
)
def _(t):
    rows = t.dialogs.withColumn("success", F.lit(True))
    done = rows.where("run_idx % 3 = 0")
    shown = [{"role": "user", "content": "example"}, {"role": "assistant", "content": "great"}]
    out = batches.judge_requests(
        rows, "reformat", "{problem} {response}", n_items=None, n_runs=None, done=done, fewshot=shown
    )
    return out.select(*keys(), F.size("convo").alias("n_messages"))


@query(
    "thinking_format", "B3",
    "SELECT conv_id, turn, E'\\n<think>\\n' || role || E'\\n</think>\\n\\n' || text || E'\\n' AS whole FROM conversations",
)
def _(t):
    whole = prompts.thinking_answer(F.col("text"), F.col("reasoning"))
    return t.dialogs.select(*keys(), whole.alias("whole"))


@query(
    "parsed_answer_steps", "P15 A30",
    "SELECT conv_id, turn, CASE WHEN readable THEN 2 END::INTEGER AS n_steps, CASE WHEN readable THEN 'answer ' || turn END AS final FROM dialogs",
)
def _(t):
    steps, final = text.answer_steps(F.col("response")), text.final_response(F.col("response"))
    n = F.when(steps.isNotNull(), F.size(steps))
    return t.dialogs.select(*keys(), n.alias("n_steps"), final.alias("final"))

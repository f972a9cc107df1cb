"""Request tables: which items still need an answer or a grade, and their prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissensus.functions import prompts, text
from dissensus.operators import joins, ordering, reshape, selection
from dissensus.schemas import ITEM

# Placeholders of the judge templates, by what the judge is shown.
JUDGE_KINDS = {
    "sentences": "steps are the sentences of the reasoning",
    "paragraphs": "steps are the numbered paragraphs of the reasoning",
    "answer_steps": "steps are those of the answer's JSON",
    "outcome": "the whole solution, reasoning and answer",
    "reformat": "the reasoning, to be put in another form",
    "verify": "the answer next to the reference solution",
    "annotators": "reasoning and answer of a per-annotator prediction",
    "ranking": "all solutions of an item",
}

# Numbers by which judge templates are referred to.
JUDGE_TEMPLATES = {
    2: "sentences",
    22: "paragraphs",
    24: "answer_steps",
    3: "outcome",
    10: "reformat",
    50: "ranking",
    60: "verify",
    100: "annotators",
}


def text_value(df: DataFrame, col: str = "text") -> Column:
    """The item text; several named texts become JSON."""
    kind = dict(df.dtypes)[col]
    return F.col(col) if kind == "string" else F.to_json(col)


def with_prompt(df: DataFrame, templates: DataFrame, name: str = "prompt") -> DataFrame:
    """Fill the template of the row's (dataset, template_id).

    Annotator metadata fills its placeholder where the frame has a column for it,
    a persona likewise. Named texts can be used by their names.
    """
    values = {"text": text_value(df)}
    if "annotator_metadata" in df.columns:
        values["annotator_metadata"] = prompts.as_json(F.col("annotator_metadata"))
    if "persona" in df.columns:
        values["persona"] = F.col("persona")
    joined = df.join(templates, ["dataset", "template_id"], "left")
    return joined.withColumn(name, prompts.fill(F.col("template"), values)).drop("template")


def with_persona_prompt(rows: DataFrame, template: Column, text_keys: list[str]) -> DataFrame:
    """Fill a template with the texts of an item by name, and a persona."""
    values = {k: F.try_element_at("text", F.lit(k)) for k in text_keys}
    return rows.withColumn("prompt", prompts.fill(template, {**values, "persona": F.col("persona")}))


def training_pairs(df: DataFrame) -> DataFrame:
    """(prompt, target) for training, or only (prompt) where there is no target."""
    if "target" in df.columns:
        return df.select("prompt", F.col("target").cast("double").alias("target"))
    return df.select("prompt")


def judge_prompt(kind: str, template: Column, df: DataFrame, problem: Column) -> Column:
    """Prompt of one judge kind; null where the answer lacks what it needs."""
    reasoning, response = F.col("reasoning"), F.col("response")
    final = text.final_response(response)
    if kind == "sentences":
        # Sentences that ``sentences.split`` found are taken as they are.
        steps = F.transform("sentences", lambda s: F.struct(s.alias("text"))) if "sentences" in df.columns else text.sentences(reasoning)
        values = {"PROBLEM": problem, "STEPS": prompts.as_json(steps)}
    elif kind == "paragraphs":
        values = {
            "PROBLEM": problem,
            "STEPS": prompts.as_json(text.paragraphs(reasoning)),
            "FINAL_RESPONSE": response,
        }
    elif kind == "answer_steps":
        steps = F.transform(
            text.answer_steps(response), lambda s, i: F.struct(i.alias("idx"), s.alias("step"))
        )
        values = {"PROBLEM": problem, "STEPS": prompts.as_json(steps), "FINAL_RESPONSE": final}
    elif kind == "outcome":
        values = {
            "llm_problem": problem,
            "llm_solution": prompts.thinking_answer(reasoning, response),
        }
    elif kind == "reformat":
        values = {"problem": problem, "response": reasoning}
    elif kind == "verify":
        values = {
            "problem": text_value(df),
            "reference_solution": F.col("target"),
            "solution": final,
        }
    elif kind == "annotators":
        values = {
            "PROBLEM": F.trim(problem),
            "REASONING": F.trim(reasoning),
            "FINAL_RESPONSE": final,
        }
    elif kind == "ranking":
        values = {"llm_problem": problem, "llm_solutions": prompts.as_json(F.col("solutions"))}
    else:
        raise ValueError(f"unknown judge kind {kind!r}; known are {sorted(JUDGE_KINDS)}")
    return prompts.fill(template, values)


def with_judge_prompt(df: DataFrame, kind: str, template: str, problem: Column | None = None) -> DataFrame:
    problem = text_value(df) if problem is None else problem
    return df.withColumn("judge_prompt", judge_prompt(kind, F.lit(template), df, problem))


def without_prompt(df: DataFrame, name: str = "judge_prompt") -> DataFrame:
    """Rows whose prompt could not be made, with the reason."""
    response = F.col("response")
    reason = (
        F.when(response.isNull() | (response == ""), "no response")
        .when(text.parse(response, text.ANSWER_WITH_STEPS).isNull(), "response not readable")
        .otherwise("part of the response is missing")
    )
    return df.where(F.col(name).isNull()).select(*[c for c in [*ITEM, "run_idx"] if c in df.columns], reason.alias("reason"))


SOLUTION_FIELDS = ("run_idx", "model_id", "reasoning", "response")


def solutions(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All solutions of an item in the order of their runs, one row each: (keys, place, ..)."""
    keys = keys or ["dataset_idx"]
    fields = [c for c in SOLUTION_FIELDS if c in df.columns]
    order = [F.col("run_idx"), F.xxhash64(*fields)]
    return ordering.running_total(df.select(*dict.fromkeys([*keys, *fields])), keys, order, name="place")


def solutions_per_item(df: DataFrame, per_row: int, keys: list[str] | None = None) -> DataFrame:
    """The solutions of an item as lists ordered by run: (keys, part, solutions).

    A list holds ``per_row`` solutions, as many as the caller's requests can take. An
    item with more of them goes on in rows with the next ``part``.
    """
    keys = keys or ["dataset_idx"]
    fields = [c for c in SOLUTION_FIELDS if c in df.columns]
    placed = solutions(df, keys)
    part = F.floor(F.col("place") / per_row).cast("int").alias("part")
    listed = F.array_sort(F.collect_list(F.struct("place", *fields)))
    return placed.groupBy(*keys, part).agg(
        F.transform(listed, lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("solutions")
    )


def conversation(fewshot: Column | None, prompt: Column) -> Column:
    """Few-shot messages followed by the prompt."""
    last = F.array(prompts.message("user", prompt))
    return last if fewshot is None else F.concat(fewshot, last)


def fewshot_messages(examples: DataFrame, order: list[Column], answer: Column) -> DataFrame:
    """Examples of a (dataset, split, template) as one array of messages.

    The array has two messages per few-shot example; their number is the user's.
    """
    pair = F.array(prompts.message("user", F.col("prompt")), prompts.message("assistant", answer))
    listed = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], pair.alias("pair"))))
    return examples.groupBy("dataset", "split", "template_id").agg(
        F.flatten(F.transform(listed, lambda x: x["pair"])).alias("fewshot")
    )


def soft_label_answer(soft_label: Column, digits: int = 3) -> Column:
    """The soft label an example answers with, rounded, as JSON."""
    return F.to_json(F.transform_values(soft_label, lambda _, v: F.round(v, digits)))


# The rows that are numbered hold the items' texts, so a range has fewer of them.
TEXT_LIMIT = ordering.SizeLimit(rows=20_000, share=1e-5)


def prediction_requests(
    items: DataFrame,
    templates: DataFrame,
    n_loops: int = 1,
    n_examples: int | None = None,
    n_fewshot: int = 0,
    rank: int = 0,
    world: int = 1,
    done: DataFrame | None = None,
    settings: dict | None = None,
) -> DataFrame:
    """One request per item, template and run that still needs an answer.

    Per dataset and split the first ``n_fewshot`` items serve as examples and the
    next ``n_examples`` (all, if None) are asked.
    """
    group = ["dataset", "split"]
    place = [F.col("dataset_idx")]
    base = ordering.running_total(items, group, place, name="__pos", limit=TEXT_LIMIT)
    asked = base.where(F.col("__pos") >= n_fewshot)
    if n_examples is not None:
        asked = asked.where(F.col("__pos") < n_fewshot + n_examples)
    asked = asked.where(F.pmod(F.col("__pos") - n_fewshot, F.lit(world)) == rank)
    runs = F.sequence(F.lit(0), F.lit(n_loops - 1))
    rows = asked.join(F.broadcast(templates.select("dataset", "template_id")), "dataset").withColumn(
        "run_idx", F.explode(runs)
    )
    if done is not None:
        keys = [*ITEM, "template_id", "run_idx"]
        finished = done.where(F.col("success")).select(*keys).distinct()
        rows = rows.join(finished, keys, "left_anti")
    rows = with_prompt(rows, templates)
    if n_fewshot:
        shown = base.where(F.col("__pos") < n_fewshot).join(
            templates.select("dataset", "template_id"), "dataset"
        )
        messages = fewshot_messages(
            with_prompt(shown, templates), [F.col("__pos")], soft_label_answer(F.col("soft_label"))
        )
        # A row per (dataset, split, template): the texts stay where they are.
        rows = rows.join(F.broadcast(messages), ["dataset", "split", "template_id"], "left")
    convo = conversation(F.col("fewshot") if n_fewshot else None, F.col("prompt"))
    for name, value in (settings or {}).items():
        rows = rows.withColumn(name, F.lit(value))
    return rows.withColumn("convo", convo).select(
        *ITEM, "template_id", "run_idx", "prompt", "convo", *(settings or {})
    )


def judge_requests(
    answers: DataFrame,
    kind: str,
    template: str,
    n_items: int | None,
    n_runs: int | None,
    spec: dict | None = None,
    at_random: bool = False,
    items: DataFrame | None = None,
    diversity: DataFrame | None = None,
    rank: int = 0,
    world: int = 1,
    done: DataFrame | None = None,
    fewshot: list[dict] | None = None,
    settings: dict | None = None,
    per_request: int | None = None,
) -> DataFrame:
    """One request per answer that is to be graded; of all items or runs where None.

    ``diversity`` limits the answers to the items of the top quintile, ``done``
    leaves out graded ones, ``fewshot`` is a list of messages put before the prompt.
    """
    from dissensus.operators import cleaning, diversity as div

    rows = cleaning.equal_to(answers.dropDuplicates(), {"success": True, **(spec or {})})
    if diversity is not None:
        rows = div.most_diverse(rows, diversity, [c for c in ITEM if c in diversity.columns])
    rows = selection.answers_to_grade(rows, n_items, n_runs, at_random)
    if items is not None:
        rows = joins.join_items(rows, items)
    if kind == "ranking":
        if per_request is None:
            raise ValueError("say how many solutions a ranking request can take")
        parts = solutions_per_item(rows, per_request, ITEM)
        rows = rows.select(*ITEM, "text").dropDuplicates(ITEM).join(parts, ITEM)
        keys = [*ITEM, "part"]
    else:
        keys = [*ITEM, "run_idx"]
    if world > 1:
        rows = selection.shard_by_position(rows, [F.col(c) for c in keys], rank, world)
    if done is not None:
        if kind == "ranking":
            raise ValueError("all solutions of an item are graded at once; nothing can be resumed")
        rows = joins.missing_answers(rows, done)
    rows = with_judge_prompt(rows, kind, template).where(F.col("judge_prompt").isNotNull())
    shown = None
    if fewshot:
        shown = F.array(*[prompts.message(m["role"], F.lit(m["content"])) for m in fewshot])
    for name, value in (settings or {}).items():
        rows = rows.withColumn(name, F.lit(value))
    extra = [c for c in ("model_id",) if c in rows.columns]
    return rows.withColumn("convo", conversation(shown, F.col("judge_prompt"))).select(
        *keys, *extra, "judge_prompt", "convo", *(settings or {})
    )


def persona_rows(
    items: DataFrame,
    annotators: DataFrame,
    per_dataset: int | None = None,
    include_none: bool = False,
    upsample_by: str | None = None,
    seed: str = "0",
) -> DataFrame:
    """Items as one row per annotator, with target, metadata and persona.

    ``target`` is an array aligned with ``annotator_ids``. Optionally only random
    items of each dataset, a copy without persona, and groups of equal size.
    """
    from dissensus.operators import resample

    if per_dataset is not None:
        items = selection.only_items(items, selection.random_items_by_dataset(items, per_dataset, seed))
    rows = joins.annotator_rows(items).drop("annotator_ids")
    if "target" in items.columns:
        rows = rows.withColumn("target", F.get("target", F.col("pos")).cast("int"))
    rows = reshape.personas(joins.with_metadata(rows, annotators), include_none)
    if upsample_by:
        order = [F.col(c) for c in [*ITEM, "pos", "persona"]]
        rows = resample.upsample(rows, upsample_by, order)
    return rows



"""From raw model answers to valid predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dissensus import registry
from dissensus.functions import text, vectors
from dissensus.operators import ordering
from dissensus.schemas import ANSWER, EXAMPLE

SOFT = "soft-label"
PERSPECTIVIST = "perspectivist"

# Columns of older files that no step reads.
HELPER_COLUMNS = ["model", "pred_sum", "request_idx"]


def successful(success: Column) -> Column:
    """A missing flag counts as success."""
    return F.coalesce(success, F.lit(True))


def drop_failed(df: DataFrame, col: str = "success") -> DataFrame:
    return df.where(successful(F.col(col)))


def recompute_success(df: DataFrame) -> DataFrame:
    """An answer that used up its token limit was cut off and is no success."""
    if not {"max_tokens", "n_output_tokens"} <= set(df.columns):
        return df
    within = F.coalesce(F.col("max_tokens") > F.col("n_output_tokens"), F.lit(False))
    return df.withColumn("success", within & F.coalesce("success", F.lit(False)))


def drop_missing(df: DataFrame, col: str = "response") -> DataFrame:
    return df.where(F.col(col).isNotNull())


def drop_blank(df: DataFrame, col: str = "response") -> DataFrame:
    """Trim a text column and drop the rows where nothing is left."""
    return df.withColumn(col, text.trimmed(F.col(col))).where(F.col(col) != "")


def equal_to(df: DataFrame, spec: dict) -> DataFrame:
    """Rows equal to the given values, over the columns the frame has."""
    for name, value in spec.items():
        if name in df.columns:
            df = df.where(F.col(name) == F.lit(value))
    return df


def with_model_size(df: DataFrame) -> DataFrame:
    """Model size as text for reports and as a number to sort by."""
    size = registry.model_size(F.col("model_id"))
    return df.withColumns({"model_size": size.cast("string"), "model_size_key": size})


def with_classes(df: DataFrame, csc_classes: int = 7) -> DataFrame:
    return df.withColumn("n_classes", registry.n_classes(F.col("dataset"), csc_classes))


def with_template_alias(df: DataFrame) -> DataFrame:
    """Add the report name of the template; an unknown template raises."""
    if "template_alias" in df.columns:
        return df
    alias = registry.template_alias(F.col("dataset"), F.col("template_id"))
    unknown = F.concat(
        F.lit("no alias for template "), F.coalesce(F.col("template_id").cast("string"), F.lit("null")),
        F.lit(" of "), F.coalesce(F.col("dataset"), F.lit("null")),
    )
    return df.withColumn("template_alias", F.coalesce(alias, F.raise_error(unknown).cast("string")))


def drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*HELPER_COLUMNS)


def scheme_vector(soft_label: Column, dataset: Column) -> Column:
    """Label map as vector by the dataset's classes; null for a key that is no label."""
    offset = registry.lookup(dataset, {n: s.offset for n, s in registry.SCHEMES.items()})
    return vectors.dense(
        soft_label, registry.n_classes(dataset), offset, dataset == F.lit("MP")
    )


def strict_vector(soft_label: Column, dataset: Column) -> Column:
    """As scheme_vector for targets: a key that is no label raises."""
    vector = scheme_vector(soft_label, dataset)
    message = F.concat(F.lit("unknown label in "), F.to_json(soft_label))
    return F.when(
        soft_label.isNotNull(),
        F.coalesce(vector, F.raise_error(message).cast("array<double>")),
    )


def prediction_entries(df: DataFrame, task: str = SOFT) -> Column:
    """The answer of a row as array of (category, pred); null or empty if unreadable.

    Soft labels with a key that is no label have a null pred.
    """
    dataset, response = F.col("dataset"), F.col("response")
    if task == SOFT:
        whole = vectors.bind(text.soft_label(response), lambda v: scheme_vector(v, dataset))
        by_category = text.soft_label_by_category(response)
        part = lambda v: scheme_vector(v, dataset)
    else:
        whole = text.int_list(response)
        by_category = text.int_list_by_category(response)
        part = lambda v: v
    # Bound, as each mention of a parse repeats it.
    single = vectors.bind(
        whole, lambda v: F.when(v.isNotNull(), F.array(F.struct(F.lit("").alias("category"), v.alias("pred"))))
    )
    split = F.transform(
        F.map_entries(by_category),
        lambda e: F.struct(e["key"].alias("category"), part(e["value"]).alias("pred")),
    )
    entries = F.when(registry.n_categories(dataset) == 1, single).otherwise(split)
    if task == SOFT:
        return entries
    # A list of labels that cannot be read stays, as an answer that is not valid.
    unread = F.array(F.struct(F.lit("").alias("category"), F.lit(None).cast("array<int>").alias("pred")))
    return F.coalesce(entries, unread)


def entries_valid(entries: Column, dataset: Column, task: str = SOFT, atol: float = 0.01) -> Column:
    """Whether every category is there and every vector or list is well formed."""
    def good(e: Column) -> Column:
        return vectors.sums_to_one(e["pred"], atol) if task == SOFT else e["pred"].isNotNull()

    return F.coalesce(
        (F.size(entries) == registry.n_categories(dataset)) & F.forall(entries, good), F.lit(False)
    )


def explode_entries(df: DataFrame, entries: Column, task: str = SOFT) -> DataFrame:
    """One row per category with its pred and whether the whole answer is valid.

    Answers without entries give no row. The parse sits in the generator alone, so
    no filter or projection around it repeats it.
    """
    def rows(t: Column) -> Column:
        return F.transform(
            t["entries"],
            lambda e: F.struct(
                e["category"].alias("category"), e["pred"].alias("pred"), t["valid"].alias("is_valid_pred")
            ),
        )

    def checked(es: Column) -> Column:
        valid = entries_valid(es, F.col("dataset"), task)
        return vectors.bind(F.struct(es.alias("entries"), valid.alias("valid")), rows)

    return df.select("*", F.inline(vectors.bind(entries, checked)))


def label_valid(df: DataFrame, col: str = "pred") -> Column:
    return registry.in_domain(F.col("dataset"), F.col(col).cast("int"))


def drop_invalid_labels(df: DataFrame, col: str = "pred") -> DataFrame:
    """Keep rows whose label the dataset allows."""
    return df.where(label_valid(df, col))


def drop_invalid(
    df: DataFrame, flag: str = "is_valid_pred", observation: Observation | None = None
) -> DataFrame:
    """Keep valid rows; an observation counts all and invalid ones in the same pass."""
    if observation is not None:
        df = df.observe(
            observation,
            F.count(F.lit(1)).alias("rows"),
            F.count_if(~F.col(flag)).alias("invalid"),
        )
    return df.where(F.col(flag))


def prepared(df: DataFrame, with_steps: bool = False) -> DataFrame:
    """Everything before the parse: names, failures, blanks, classes, code fence."""
    df = df.withColumn("gen_kwargs", registry.gen_kwargs_name(F.col("gen_kwargs")))
    df = drop_failed(df)
    df = with_model_size(df)
    df = df.withColumn("template_id", F.col("template_id").cast("int"))
    df = drop_blank(drop_missing(df))
    df = with_classes(df)
    answer = text.json_fence(F.col("response"))
    return df.withColumn("response", text.final_response(answer) if with_steps else answer)


def clean(
    df: DataFrame,
    task: str = SOFT,
    with_steps: bool = False,
    discard_invalid: bool = False,
    observation: Observation | None = None,
) -> DataFrame:
    """Raw answers to predictions in rows of (.., category, pred, is_valid_pred)."""
    df = prepared(df, with_steps)
    df = explode_entries(df, prediction_entries(df, task), task)
    if task == SOFT:
        df = drop_missing(df, "pred")
    if discard_invalid:
        df = drop_invalid(df, observation=observation)
    return drop_helpers(with_template_alias(df))


def rejected(df: DataFrame, task: str = SOFT, with_steps: bool = False) -> DataFrame:
    """The answers ``clean`` leaves out, each with the reason."""
    keys = [c for c in [*EXAMPLE, "run_idx"] if c in df.columns]
    raw = df.withColumn("__raw", text.trimmed(F.col("response")))
    answer = text.json_fence(F.col("__raw"))
    raw = raw.withColumn("response", text.final_response(answer) if with_steps else answer)
    checked = vectors.bind(
        prediction_entries(raw, task),
        lambda es: F.when(es.isNull() | (F.size(es) == 0), "not readable").when(
            ~entries_valid(es, F.col("dataset"), task), "not valid"
        ),
    )
    reason = (
        F.when(~successful(F.col("success")), "failed")
        .when(F.col("__raw").isNull(), "no response")
        .when(F.col("__raw") == "", "blank response")
        .otherwise(checked)
    )
    found = F.explode(F.array_compact(F.array(reason))).alias("reason")
    return raw.select(*keys, found)


def distinct_answers(df: DataFrame, keys: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """One row per (item, run): the first by ``order``, the earliest by default."""
    keys = [c for c in (keys or ANSWER) if c in df.columns]
    if order is None:
        order = [F.col(c).asc_nulls_last() for c in ("timestamp",) if c in df.columns]
        # Maps have no hash.
        hashed = [c for c, kind in df.dtypes if c not in keys and "map<" not in kind]
        order.append(F.xxhash64(*hashed).asc())
    return ordering.first_rows(df, keys, order)


def same_length(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Keep rows whose pred and target have the same length.

    With categories, an answer stays if the summed lengths over its categories agree.
    """
    if "category" not in df.columns:
        return df.where(F.size("pred") == F.size("target"))
    keys = [c for c in (keys or [*EXAMPLE, "run_idx"]) if c in df.columns]
    lengths = df.groupBy(*keys).agg(
        F.sum(F.size("pred")).alias("__p"), F.sum(F.size("target")).alias("__t")
    )
    good = lengths.where(F.col("__p") == F.col("__t")).select(*keys)
    return df.join(good, keys, "left_semi")


def same_annotators(df: DataFrame) -> DataFrame:
    """Keep rows that have one label per annotator."""
    return df.where(F.size("pred") == F.col("n_annotators"))


def annotator_count(df: DataFrame, keys: list[str], on_rows: bool = False) -> DataFrame:
    """Annotators of each prediction; null where its categories disagree.

    One row per prediction, or ``on_rows`` as a column of the rows. The rows of a
    prediction meet in a window then, so they must be few, as its categories are.
    """
    least, most = F.min(F.size("pred")), F.max(F.size("pred"))
    if on_rows:
        least, most = (x.over(W.partitionBy(*keys)) for x in (least, most))
        return df.withColumns({"__least": least, "n_pred_annotators": most}).withColumn(
            "n_pred_annotators", F.when(F.col("__least") == F.col("n_pred_annotators"), F.col("n_pred_annotators"))
        ).drop("__least")
    return df.groupBy(*keys).agg(F.when(least == most, most).alias("n_pred_annotators"))

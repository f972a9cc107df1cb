"""Evaluation of labels and distributions, by dataset and method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissensus import registry
from dissensus.functions import ratings as grades
from dissensus.operators import agreement, cleaning, distributions, metrics, ordering, resample, votes
from dissensus.schemas import ITEM

REPORT_KEYS = ["dataset", "split", "template_id", "model_size", "model_id", "gen_kwargs"]


def validity(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of valid predictions, and how many were looked at.

    Counts answers; an answer with several categories has one row for each, of
    which the first counts.
    """
    keys = keys or [c for c in REPORT_KEYS if c in df.columns]
    share = 1.0 / registry.n_categories(F.col("dataset")) if "category" in df.columns else F.lit(1.0)
    valid = F.col("is_valid_pred").cast("int")
    return df.groupBy(*keys).agg(
        F.avg(valid).alias("is_valid_pred"),
        F.round(F.sum(share)).cast("bigint").alias("validity_count"),
    )


def losses(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean distance, and how many answers have one."""
    keys = keys or [c for c in REPORT_KEYS if c in df.columns]
    share = 1.0 / registry.n_categories(F.col("dataset")) if "category" in df.columns else F.lit(1.0)
    return df.groupBy(*keys).agg(
        F.avg("ws_loss").alias("avg_ws_loss"),
        F.round(F.sum(F.when(F.col("ws_loss").isNotNull(), share))).cast("bigint").alias("loss_count"),
    )


def validity_and_losses(valid: DataFrame, loss: DataFrame, keys: list[str]) -> DataFrame:
    return valid.join(loss, keys, "left")


def label_accuracy(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Accuracy, mean distance and count of single labels."""
    return (
        metrics.label_distance(df)
        .groupBy(*(keys or ["dataset"]))
        .agg(
            F.avg(F.col("correct").cast("int")).alias("correct"),
            F.avg("abs_dist").alias("abs_dist"),
            F.count("correct").alias("count"),
        )
    )


def label_f1(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """F1, precision and recall of the binary datasets."""
    return agreement.binary_scores(df.where(registry.is_binary(F.col("dataset"))), keys or ["dataset"])


def soft_label_rows(preds: DataFrame, targets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Labels of an item as a distribution, with its distance to the target.

    Where no item is large its labels and its target meet in one task, of as many tasks
    as the rows need.
    """
    preds = ordering.together(preds, ITEM)
    shares = distributions.soft_labels(preds, [*(by or []), *ITEM])
    keys = [c for c in ITEM if c in targets.columns]
    return metrics.with_wasserstein(shares.join(targets.select(*keys, "target"), keys, "inner"))


def soft_label_scores(preds: DataFrame, targets: DataFrame, by: list[str] | None = None) -> DataFrame:
    rows = soft_label_rows(preds, targets, by)
    return rows.groupBy(*(by or []), "dataset").agg(
        F.avg("ws_loss").alias("ws_loss"), F.count("ws_loss").alias("count")
    )


def with_all_votes(preds: DataFrame) -> DataFrame:
    """Single labels and the labels of every vote rule, as one table with a ``name``."""
    keys = votes.vote_keys(preds)
    single = preds.select(*keys, F.lit("simple").alias("name"), F.col("pred").cast("int").alias("pred"))
    return single.unionByName(votes.all_votes(preds, keys))


def evaluate(preds: DataFrame, targets: DataFrame) -> dict[str, DataFrame]:
    """All evaluations of per-annotator labels, with a ``name`` for the vote rule.

    The tables can be stacked (``stack``), extended and filtered like any frame.
    """
    rows = with_all_votes(preds)
    return {
        "labels": metrics.label_distance(rows),
        "accuracy": label_accuracy(rows, ["name", "dataset"]),
        "f1": label_f1(rows, ["name", "dataset"]),
        "soft_label_rows": soft_label_rows(rows, targets, ["name"]),
        "soft_label": soft_label_scores(rows, targets, ["name"]),
    }


def stack(*bundles: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Bundles of tables on top of each other, name by name."""
    out = dict(bundles[0])
    for bundle in bundles[1:]:
        for name, df in bundle.items():
            out[name] = out[name].unionByName(df, allowMissingColumns=True) if name in out else df
    return out


def with_column(bundle: dict[str, DataFrame], col: str, value) -> dict[str, DataFrame]:
    return {name: df.withColumn(col, F.lit(value)) for name, df in bundle.items()}


def only(bundle: dict[str, DataFrame], condition: str) -> dict[str, DataFrame]:
    return {name: df.where(condition) for name, df in bundle.items()}


def graded(ratings: DataFrame, values: dict | None = None, reduction: str = "mean", drop_missing: bool = True) -> DataFrame:
    """Grades and score of each judged answer; unreadable grades are left out."""
    parsed = ratings.withColumn(
        "step_ratings", grades.step_grades(grades.parse_ratings(F.col("response")), values)
    ).where(F.col("step_ratings").isNotNull())
    scored = parsed.withColumn("score", grades.score(F.col("step_ratings"), reduction))
    return cleaning.drop_missing(scored, "score") if drop_missing else scored


def score_from_json(ratings: DataFrame, reduction: str = "mean") -> DataFrame:
    return graded(ratings, grades.GRADE_MAPPINGS["ok=0"], reduction)


def score_from_number(ratings: DataFrame) -> DataFrame:
    from dissensus.functions import text

    return cleaning.drop_missing(ratings.withColumn("score", text.number(F.col("response"))), "score")


def configuration_scores(ratings: DataFrame) -> tuple[DataFrame, dict[tuple[str, str], str]]:
    """Ratings with a score column for every grade mapping and reduction, and its name.

    The ratings are parsed once and graded once for each mapping.
    """
    out = ratings.withColumn("__r", grades.parse_ratings(F.col("response")))
    mapped = {m: f"__g{i}" for i, m in enumerate(grades.GRADE_MAPPINGS)}
    out = out.withColumns({g: grades.step_grades(F.col("__r"), grades.GRADE_MAPPINGS[m]) for m, g in mapped.items()})
    names = {(m, operation): f"{g}_{operation}" for m, g in mapped.items() for operation in grades.REDUCTIONS}
    scores = {name: grades.score(F.col(mapped[m]), operation) for (m, operation), name in names.items()}
    return out.withColumns(scores).drop("__r", *mapped.values()), names


def rating_configurations(ratings: DataFrame) -> DataFrame:
    """Scores of each judged answer under every grade mapping and reduction.

    The configurations are an array in the row, so the ratings are parsed once.
    """
    scored, names = configuration_scores(ratings)
    configs = [
        F.struct(F.lit(m).alias("mapping"), F.lit(operation).alias("operation"), F.col(name).alias("score"))
        for (m, operation), name in names.items()
    ]
    return scored.select(
        *[c for c in ratings.columns if c != "response"], F.inline(F.array(*configs))
    ).where(F.col("score").isNotNull())


def rating_matrix(
    ratings: DataFrame,
    item: list[str],
    run: list[str],
    value: str = "is_correct",
    draws: int = 50,
    bound: DataFrame | None = None,
    **bootstrap,
) -> DataFrame:
    """Best-of-N quality of each grade mapping and reduction, with an interval.

    Where ``bound`` shows that no item is large, an answer is shuffled once for all
    mappings, reductions and draws (see ``resample.best_in_place``).
    """
    keys = ["mapping", "operation"]
    cols = [F.col(c) for c in run]
    n = ordering.rows_if_small(bound, item) if draws <= resample.PLACE_DRAWS else None
    if n is not None:
        scored, names = configuration_scores(ratings)
        known = {name: F.col(name).isNotNull() for name in names.values()}
        # The draws' seed is that of best_with_random_ties.
        best = resample.best_in_place(scored, [], item, cols, value, draws, known, "0", n)
        found = F.array(
            *[F.struct(F.lit(m).alias("mapping"), F.lit(o).alias("operation"), F.col(n).alias("draws")) for (m, o), n in names.items()]
        )
        means = (
            best.select(F.inline(found))
            .select(*keys, F.inline("draws"))
            .groupBy(*keys, "draw")
            .agg(F.avg("value").alias(value))
        )
    else:
        means = resample.best_with_random_ties(rating_configurations(ratings), keys, item, cols, value, draws)
    return resample.bootstrap_mean(means, keys, value, [*map(F.col, keys), F.col("draw")], **bootstrap)


def accuracy_intervals(df: DataFrame, attribute: str, **bootstrap) -> DataFrame:
    """Accuracy by an attribute of the annotator's metadata, with a bootstrap interval.

    Right and wrong answers of an attribute are counted before anything is drawn.
    """
    value = F.try_element_at("metadata", F.lit(attribute))
    rows = df.select(value.alias(attribute), (F.col("pred") == F.col("target")).cast("int").alias("correct"))
    return resample.counted_bootstrap(rows, [attribute], "correct", **bootstrap)


def accuracy_by_attribute(df: DataFrame, attribute: str) -> DataFrame:
    """Accuracy by an attribute of the annotator's metadata."""
    value = F.try_element_at("metadata", F.lit(attribute))
    return df.withColumn(attribute, value).groupBy(attribute).agg(
        F.avg((F.col("pred") == F.col("target")).cast("int")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def dataset_sizes(items: DataFrame, splits: list[str] | None = None, long: bool = False) -> DataFrame:
    """Items by dataset and split, as columns per split or as rows."""
    if long:
        return items.groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("n_rows"))
    return items.groupBy("dataset").pivot("split", splits).agg(F.count(F.lit(1)))


def group_sizes(df: DataFrame, key: str = "dataset") -> DataFrame:
    return df.groupBy(key).agg(
        F.count("dataset_idx").alias("n_rows"),
        F.count_distinct("dataset_idx").alias("n_items"),
    )

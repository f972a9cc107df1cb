"""What is known about each dataset and model, as literal column lookups.

The tables have a handful of rows fixed by the label schemes, so a lookup is a
constant-folded CASE expression and needs no join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LabelScheme:
    """Labels ``first..last`` of a dataset; ``offset`` turns one into a class index."""

    n_classes: int
    first: int
    last: int
    offset: int
    categories: tuple[str, ...] = ("",)
    short_name: str = ""
    file_name: str = ""

    @property
    def binary(self) -> bool:
        return self.n_classes == 2


# Label schemes, short names and file names of the datasets.
SCHEMES = {
    "CSC": LabelScheme(7, 1, 6, 0, ("",), "CSC", "csc"),
    "MP": LabelScheme(2, 0, 1, 0, ("",), "MP", "mp"),
    "Paraphrase": LabelScheme(11, -5, 5, 5, ("",), "PAR", "par"),
    "VariErrNLI": LabelScheme(
        2, 0, 1, 0, ("entailment", "neutral", "contradiction"), "VEN", "ven"
    ),
}

# Order in which the three categories are written to a file.
SUBMISSION_CATEGORIES = ("contradiction", "entailment", "neutral")

# Datasets with a free-text answer instead of labels.
MATH_DATASETS = ("prm800k", "aime")

# Model sizes in billions of parameters.
MODEL_SIZES = {
    "Qwen/Qwen3-0.6B": 0.6,
    "Qwen/Qwen3-1.7B": 1.7,
    "Qwen/Qwen3-4B": 4.0,
    "Qwen/Qwen3-8B": 8.0,
    "Qwen/Qwen3-14B": 14.0,
    "Qwen/Qwen3-32B": 32.0,
    "Qwen/Qwen3-72B": 72.0,
    "Qwen/Qwen3-235B-A22B": 235.0,
    "qwen/qwen3-235b-a22b-2507": 235.0,
}

# Short model names.
MODEL_NAMES = {
    "Qwen/Qwen3-32B": "Qwen3-32B",
    "deepseek-ai/DeepSeek-R1-0528-Qwen3-8B": "DeepSeek-R1-8B",
}

# Old names of generation settings.
GEN_KWARGS_NAMES = {"thinking": "set1", "nonthinking": "set2"}

# What each prompt template is called in reports.
TEMPLATE_ALIASES = {
    2: "0 simple",
    3: "1 +def",
    32: "2 +pers",
    31: "3 +def+pers",
    33: "perspectivist",
    60: "incl. steps (soft-label)",
    63: "incl. steps (perspectivist)",
    62: "incl. steps (soft-label) -def",
}

MAX_CLASSES = max(s.n_classes for s in SCHEMES.values())


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """CASE expression over a small fixed table."""
    out = None
    for k, v in table.items():
        value = v if isinstance(v, Column) else F.lit(v)
        out = F.when(key == F.lit(k), value) if out is None else out.when(key == F.lit(k), value)
    return out if default is None else out.otherwise(default)


def n_classes(dataset: Column, csc_classes: int = 7) -> Column:
    """Number of classes; CSC has an unused class 0, which 6 leaves out."""
    sizes = {name: s.n_classes for name, s in SCHEMES.items()}
    sizes["CSC"] = csc_classes
    return lookup(dataset, sizes)


def class_index(dataset: Column, label: Column) -> Column:
    """Class index of an integer label."""
    return (label + lookup(dataset, {n: s.offset for n, s in SCHEMES.items()})).cast("int")


def in_domain(dataset: Column, label: Column) -> Column:
    """Whether an integer label is one the dataset allows; unknown datasets allow none."""
    return F.coalesce(
        lookup(dataset, {n: label.between(s.first, s.last) for n, s in SCHEMES.items()}),
        F.lit(False),
    )


def is_binary(dataset: Column) -> Column:
    return lookup(dataset, {n: s.binary for n, s in SCHEMES.items()}, F.lit(False))


def n_categories(dataset: Column) -> Column:
    return lookup(dataset, {n: len(s.categories) for n, s in SCHEMES.items()})


def short_name(dataset: Column) -> Column:
    return lookup(dataset, {n: s.short_name for n, s in SCHEMES.items()}, dataset)


def model_size(model_id: Column) -> Column:
    return lookup(model_id, MODEL_SIZES)


def model_name(model_id: Column) -> Column:
    return lookup(model_id, MODEL_NAMES, model_id)


def gen_kwargs_name(gen_kwargs: Column) -> Column:
    return lookup(gen_kwargs, GEN_KWARGS_NAMES, gen_kwargs)


def template_alias(dataset: Column, template_id: Column) -> Column:
    """Report name of a template; null for an unknown template or dataset."""
    return F.when(dataset.isin(list(SCHEMES)), lookup(template_id.cast("int"), TEMPLATE_ALIASES))


def domain_name(dataset: Column) -> Column:
    """``Math`` or ``other``."""
    return F.when(F.lower(dataset).isin(list(MATH_DATASETS)), "Math").otherwise("other")


def scheme_table(spark: SparkSession) -> DataFrame:
    """The schemes as a table of (dataset, category)."""
    rows = [
        (name, c, s.n_classes, s.first, s.last, s.offset, s.binary, s.short_name)
        for name, s in SCHEMES.items()
        for c in s.categories
    ]
    return spark.createDataFrame(
        rows,
        "dataset string, category string, n_classes int, first_label int, last_label int, "
        "class_offset int, is_binary boolean, short_name string",
    )

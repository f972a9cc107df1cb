"""Step grades of a judge, and their reduction to one score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from dissensus.functions import text, vectors
from dissensus.schemas import RATED_STEPS


# The words that grade a step, as numbers.
SIGNED_GRADES = {"great": 1.0, "ok": 0.0, "okay": 0.0, "bad": -1.0}
# The two ways of valuing a middling step that are compared.
GRADE_MAPPINGS = {
    "ok=0": {"great": 1.0, "ok": 0.0, "okay": 0.0, "bad": 0.0},
    "ok=1": {"great": 1.0, "ok": 1.0, "okay": 1.0, "bad": 0.0},
}


def product(grades: Column) -> Column:
    return F.when(
        F.size(grades) > 0, F.aggregate(grades, F.lit(1.0), lambda acc, x: acc * x)
    )


REDUCTIONS: dict[str, Callable[[Column], Column]] = {
    "mean": vectors.mean,
    "product": product,
    "min": F.array_min,
}


def parse_ratings(response: Column) -> Column:
    """A judge's answer as list of rated steps; null where it is not one."""
    return text.parse(response, RATED_STEPS)


def step_grades(rated_steps: Column, values: dict[str, float] | None = None) -> Column:
    """Grades of the steps as numbers; null as soon as one grade is not a known word."""
    values = SIGNED_GRADES if values is None else values
    words = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return vectors.bind(
        F.transform(rated_steps, lambda s: F.try_element_at(words, s["rating"])),
        lambda g: F.when(F.forall(g, lambda x: x.isNotNull()), g),
    )


def score(grades: Column, reduction: str = "mean") -> Column:
    return REDUCTIONS[reduction](grades)


def ok_share(annotations: Column, ok: str = "1 - ok") -> Column:
    """Share of sentence annotations that are marked ok."""
    return F.try_divide(
        F.size(F.filter(annotations, lambda a: a["annotation"] == F.lit(ok))), F.size(annotations)
    )

"""Arithmetic on label distributions held as ``array<double>``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A higher-order function evaluates its lambda per element, so a total that is
    used inside one has to be bound outside of it.
    """
    return F.transform(F.array(value), body)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def mean(v: Column) -> Column:
    """Mean of an array; null for an empty one."""
    return F.try_divide(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x), F.size(v))


def variance(v: Column) -> Column:
    """Population variance of an array."""
    return bind(
        F.struct(v.alias("v"), mean(v).alias("m")),
        lambda t: mean(F.transform(t["v"], lambda x: (x - t["m"]) * (x - t["m"]))),
    )


def normalised(v: Column) -> Column:
    """The vector divided by its sum; elements are null where the sum is 0."""
    return bind(
        F.struct(v.alias("v"), total(v).alias("s")),
        lambda t: F.transform(t["v"], lambda x: F.try_divide(x, t["s"])),
    )


def cumulative(v: Column) -> Column:
    """Cumulative shares of a vector."""
    return bind(
        F.struct(v.alias("v"), total(v).alias("s")),
        lambda t: F.transform(
            t["v"],
            lambda _, i: F.try_divide(total(F.slice(t["v"], F.lit(1), i + 1)), t["s"]),
        ),
    )


def entropy(v: Column) -> Column:
    """Natural-log entropy of the vector taken as a distribution.

    With s the sum, the entropy is ``ln s - sum(x ln x) / s``: one pass, no
    normalised copy.
    """
    sums = F.aggregate(
        v,
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("xlx")),
        lambda acc, x: F.struct(
            (acc["s"] + x).alias("s"),
            (acc["xlx"] + F.when(x > 0, x * F.ln(x)).otherwise(0.0)).alias("xlx"),
        ),
    )
    return bind(
        sums, lambda t: F.when(t["s"] > 0, F.ln(t["s"]) - F.try_divide(t["xlx"], t["s"]))
    )


def wasserstein(p: Column, q: Column) -> Column:
    """Wasserstein-1 distance of two distributions over the same class indexes.

    It is the summed absolute difference of the cumulative shares. Both sides are
    divided by their sums; unequal lengths and zero sums give null.
    """
    sums = F.struct(p.alias("p"), q.alias("q"), total(p).alias("sp"), total(q).alias("sq"))
    start = F.struct(F.lit(0.0).alias("gap"), F.lit(0.0).alias("dist"))

    def step(acc: Column, d: Column) -> Column:
        gap = acc["gap"] + d
        return F.struct(gap.alias("gap"), (acc["dist"] + F.abs(gap)).alias("dist"))

    def distance(t: Column) -> Column:
        diffs = F.zip_with(
            t["p"], t["q"], lambda a, b: F.try_divide(a, t["sp"]) - F.try_divide(b, t["sq"])
        )
        return F.aggregate(diffs, start, step, lambda acc: acc["dist"])

    return F.when(F.size(p) == F.size(q), bind(sums, distance))


def at(v: str, k: int) -> str:
    """SQL of element k of a vector column, 0 behind its end."""
    return f"coalesce(get({v}, {k}), 0D)"


def wasserstein_up_to(p: str, q: str, sp: str, sq: str, width: int) -> Column:
    """The distance of two vector columns of at most ``width`` classes, given their sums.

    Written out class by class, it compiles to plain code; a higher-order function
    is interpreted per element. Longer vectors take the general form.
    """
    def share(v: str, s: str, k: int) -> str:
        return f"try_divide({' + '.join(at(v, i) for i in range(k + 1))}, {s})"

    gaps = [f"abs({share(p, sp, k)} - {share(q, sq, k)})" for k in range(width - 1)]
    return F.when(F.size(p) != F.size(q), F.lit(None).cast("double")).when(
        F.size(p) <= width, F.expr(" + ".join(gaps))
    ).otherwise(wasserstein(F.col(p), F.col(q)))


def entropy_up_to(v: str, s: str, width: int) -> Column:
    """Entropy of a vector column of at most ``width`` classes with the sum ``s``."""
    terms = [f"if({at(v, k)} > 0, {at(v, k)} * ln({at(v, k)}), 0D)" for k in range(width)]
    written_out = F.expr(f"ln({s}) - try_divide({' + '.join(terms)}, {s})")
    return F.when(
        F.col(s) > 0, F.when(F.size(v) <= width, written_out).otherwise(entropy(F.col(v)))
    )


def mean_abs_diff(p: Column, q: Column) -> Column:
    """Mean absolute difference of two arrays of the same length, else null."""
    diffs = F.zip_with(p, q, lambda a, b: F.abs(a - b).cast("double"))
    return F.when(F.size(p) == F.size(q), mean(diffs))


def has_holes(v: Column) -> Column:
    """Whether zeros lie between nonzero classes; never for two classes or fewer."""
    marks = F.array_join(F.transform(v, lambda x: F.when(x != 0, "1").otherwise("0")), "")
    return (F.size(v) > 2) & F.rlike(marks, F.lit("10+1"))


def dense(
    soft_label: Column, n: Column, offset: Column, decimal_labels: Column | None = None
) -> Column:
    """Map of label text to share, as a vector of ``n`` classes.

    A label must be written as a plain integer, or as ``1.0`` where ``decimal_labels``
    holds. Any other key makes the result null.
    """
    def entry(e: Column) -> Column:
        label = e["key"].try_cast("double").try_cast("int")
        text = label.cast("string")
        spelled = e["key"] == text
        if decimal_labels is not None:
            spelled = spelled | (decimal_labels & (e["key"] == F.concat(text, F.lit(".0"))))
        return F.struct(F.when(spelled, label + offset).alias("i"), e["value"].alias("p"))

    def fill(es: Column) -> Column:
        known = F.forall(es, lambda e: F.coalesce((e["i"] >= 0) & (e["i"] < n), F.lit(False)))
        vector = F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda k: F.aggregate(
                es, F.lit(0.0), lambda acc, e: F.when(e["i"] == k, e["p"]).otherwise(acc)
            ),
        )
        return F.when(known, vector)

    return F.when(soft_label.isNotNull(), bind(F.transform(F.map_entries(soft_label), entry), fill))


def shares(indexes: Column, n: Column) -> Column:
    """Array of class indexes as a vector of shares; null for an empty array."""
    return bind(
        indexes,
        lambda a: F.when(
            F.size(a) > 0,
            F.transform(
                F.sequence(F.lit(0), n - 1),
                lambda k: F.size(F.filter(a, lambda x: x == k)) / F.size(a),
            ),
        ),
    )


def uniform(n: Column) -> Column:
    return F.array_repeat(1.0 / n, n.cast("int"))


def smoothed(v: Column) -> Column:
    """Half the vector, half the uniform distribution."""
    return F.transform(v, lambda x: (x + 1.0 / F.size(v)) / 2)


def max_wasserstein(n: Column) -> Column:
    """Distance between the first and the last class."""
    return (n - 1).cast("double")


def max_entropy(n: Column) -> Column:
    return F.ln(n.cast("double"))


def sums_to_one(v: Column, atol: float = 0.01) -> Column:
    return F.coalesce(F.abs(total(v) - 1.0) < atol, F.lit(False))


def rounded(v: Column, digits: int) -> Column:
    return F.transform(v, lambda x: F.round(x, digits))

"""Column functions against literal cases and small loops."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dissensus import registry
from dissensus.functions import prompts, ratings, rng, text, vectors
from dissensus.operators import cleaning, metrics


def array(xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def emd(p, q):
    p, q = np.array(p, float) / sum(p), np.array(q, float) / sum(q)
    return float(np.abs(np.cumsum(p - q)).sum())


def test_holes(spark):
    """A hole is a zero between two values, for every pattern of up to six classes."""
    patterns = [[int(b) for b in f"{k:0{n}b}"] for n in range(2, 7) for k in range(1, 2**n)]

    def hole(p):
        return any(p[i] == 0 and any(p[:i]) and any(p[i:]) for i in range(len(p)))

    rows = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(patterns)], "i int, v array<double>")
    found = dict(map(tuple, rows.select("i", vectors.has_holes(F.col("v"))).collect()))
    assert [found[i] for i in range(len(patterns))] == [hole(p) for p in patterns]


def test_wasserstein_of_the_known_case(spark):
    target = [0, 0.5, 0, 0.33333333, 0, 0.16666667, 0]
    pred = [0, 0.7, 0.2, 0.05, 0.03, 0.01, 0.01]
    assert value(spark, vectors.wasserstein(array(target), array(pred))) == pytest.approx(0.87333, abs=1e-5)


def test_wasserstein_of_odd_input(spark):
    assert value(spark, vectors.wasserstein(array([1, 0]), array([1, 0, 0]))) is None
    assert value(spark, vectors.wasserstein(array([0, 0]), array([1, 0]))) is None


vector = st.lists(st.floats(0.01, 5), min_size=4, max_size=4)


def test_metrics_against_loops(spark):
    r = np.random.default_rng(0)
    rows = []
    for n in (2, 7, 11, 20):
        for _ in range(20):
            p, q = r.random(n) * (r.random(n) > 0.3) + 1e-3, r.random(n)
            rows.append((n, p.tolist(), q.tolist()))
    df = spark.createDataFrame(rows, "n_classes int, target array<double>, pred array<double>")
    for row in metrics.with_soft_metrics(df).collect():
        p, q = np.array(row["target"]), np.array(row["pred"])
        h = q / q.sum()
        assert row["ws_loss"] == pytest.approx(emd(p, q), abs=1e-9)
        assert row["pred_entropy"] == pytest.approx(float(-(h * np.log(h)).sum()), abs=1e-9)
        assert row["normed_ws_loss"] == pytest.approx(emd(p, q) / (row["n_classes"] - 1), abs=1e-9)


def test_written_out_form_equals_general_form(spark):
    r = np.random.default_rng(1)
    rows = [(r.random(n).tolist(), r.random(n).tolist()) for n in (2, 7, 11) for _ in range(10)]
    df = spark.createDataFrame(rows, "target array<double>, pred array<double>")
    out = metrics.with_wasserstein(df).withColumn("g", vectors.wasserstein(F.col("target"), F.col("pred")))
    assert all(abs(x["ws_loss"] - x["g"]) < 1e-12 for x in out.collect())


@settings(max_examples=10, deadline=None)
@given(p=vector, q=vector)
def test_wasserstein_is_a_distance(spark, p, q):
    a, b = array(p), array(q)
    row = spark.range(1).select(
        vectors.wasserstein(a, b).alias("ab"), vectors.wasserstein(b, a).alias("ba"), vectors.wasserstein(a, a).alias("aa")
    ).first()
    assert row["ab"] == pytest.approx(row["ba"], abs=1e-9)
    assert row["ab"] == pytest.approx(emd(p, q), abs=1e-9)
    assert row["aa"] == pytest.approx(0, abs=1e-12)


@pytest.mark.parametrize("dataset", sorted(registry.SCHEMES))
def test_ints_to_shares(spark, dataset):
    scheme, rng = registry.SCHEMES[dataset], random.Random(dataset)
    name = F.lit(dataset)
    for size in (1, 3, 17):
        ints = [rng.randint(scheme.first, scheme.last) for _ in range(size)]
        indexes = F.transform(F.array(*map(F.lit, ints)), lambda x: registry.class_index(name, x))
        expected = [ints.count(k) / size for k in range(scheme.first, scheme.last + 1)]
        got = value(spark, vectors.shares(indexes, registry.n_classes(name)))
        # Classes below the first label, if any, are empty.
        assert got[len(got) - len(expected):] == pytest.approx(expected) and sum(got) == pytest.approx(1)


@pytest.mark.parametrize("dataset", [*sorted(registry.SCHEMES), "unknown"])
def test_label_domain(spark, dataset):
    scheme = registry.SCHEMES.get(dataset)
    first, last = (scheme.first, scheme.last) if scheme else (0, 0)
    labels = list(range(first - 2, last + 3))
    rows = spark.createDataFrame([(x,) for x in labels], "x int")
    got = dict(map(tuple, rows.select("x", registry.in_domain(F.lit(dataset), F.col("x"))).collect()))
    assert got == {x: scheme is not None and first <= x <= last for x in labels}


def test_soft_label_spelling(spark):
    def vec(dataset, label):
        m = F.from_json(F.lit(json.dumps(label)), "map<string,double>")
        return value(spark, cleaning.scheme_vector(m, F.lit(dataset)))

    assert vec("MP", {"0.0": 0.25, "1": 0.75}) == [0.25, 0.75]
    assert vec("CSC", {"1.0": 1.0}) is None
    assert vec("CSC", {"7": 1.0}) is None
    assert vec("Paraphrase", {"-5": 0.5, "5": 0.5})[0] == 0.5
    assert vec("MP", {"two": 1.0}) is None
    assert vec("MP", {}) == [0, 0]


def test_unknown_target_label_raises(spark):
    df = spark.range(1).select(F.create_map(F.lit("9"), F.lit(1.0)).alias("m"))
    with pytest.raises(Exception, match="unknown label"):
        df.select(cleaning.strict_vector(F.col("m"), F.lit("CSC"))).collect()


@pytest.mark.parametrize(
    "response,expected",
    [
        ("```json{a: 1}```", "{a: 1}"),
        ("{b: 2}", "{b: 2}"),
        ("hello! ```json{c: 3}``` something", "{c: 3}"),
        ("a ```json\n{1}\n``` b ```json {2} ```", "\n{1}\n"),
    ],
)
def test_json_fence(spark, response, expected):
    assert value(spark, text.json_fence(F.lit(response))) == expected


@pytest.mark.parametrize(
    "response,expected",
    [
        ('{"0": 0.4, "1": 0.6}', {"0": 0.4, "1": 0.6}),
        ("{'0': 0.4, '1': 0.6}", {"0": 0.4, "1": 0.6}),
        ("{a: 1}", {"a": 1.0}),
        ('The answer is {"0": 0.4, "1": 0.6,} I think', {"0": 0.4, "1": 0.6}),
        ("[1, 2]", None),
        ('{"0": 0.4, "1"', {"0": 0.4}),
        ('{"0": 0.4, "1": 0.6', {"0": 0.4, "1": 0.6}),
        ('I think [maybe]: {"0": 0.4, "1": 0.6}', {"0": 0.4, "1": 0.6}),
        ('a {"0": 0.4} b {', {"0": 0.4}),
        ("{", {}),
        ("", None),
        ("no json", None),
    ],
)
def test_lenient_json(spark, response, expected):
    assert value(spark, text.soft_label(F.lit(response))) == expected


def test_answer_with_steps(spark):
    raw = json.dumps({"steps": ["a", "b"], "final_response": {"0": 0.5, "1": 0.5}})
    assert value(spark, text.answer_steps(F.lit(raw))) == ["a", "b"]
    assert json.loads(value(spark, text.final_response(F.lit(raw)))) == {"0": 0.5, "1": 0.5}
    assert value(spark, text.final_response(F.lit("{}"))) is None


def test_numbers(spark):
    assert value(spark, text.number(F.lit(" 0.5 "))) == 0.5
    assert value(spark, text.number(F.lit("half"))) is None
    assert value(spark, text.whole_number(F.lit("12.99999999999"))) == 12
    assert value(spark, text.whole_number(F.lit("x"))) is None
    assert value(spark, text.whole_number(F.lit("-1234567890123"))) == -1234567890123
    assert value(spark, text.whole_number(F.lit("9" * 30))) is None
    assert value(spark, text.int_or_text(F.lit("3"))) == "3"
    assert value(spark, text.int_or_text(F.lit("entailment"))) == "entailment"


def test_paragraphs_keep_their_number(spark):
    steps = value(spark, text.paragraphs(F.lit("a\n\n \n\nb")))
    assert [(s["idx"], s["text"]) for s in steps] == [(0, "a"), (2, "b")]
    assert value(spark, text.n_paragraphs(F.lit("a\n\n \n\nb"))) == 3


def test_boxed_answer(spark):
    assert value(spark, text.boxed_answer(F.lit(r"x \boxed{\frac{1}{2}} y"))) == r"\frac{1}{2}"
    assert value(spark, text.boxed_answer(F.lit("none"))) is None


def test_grades(spark):
    steps = F.from_json(F.lit('[{"idx":0,"rating":"great"},{"idx":1,"rating":"okay"}]'), "array<struct<idx:int,rating:string>>")
    half = ratings.step_grades(steps, ratings.GRADE_MAPPINGS["ok=0"] | {"ok": 0.5, "okay": 0.5})
    assert value(spark, half) == [1.0, 0.5]
    assert value(spark, ratings.score(half, "mean")) == 0.75
    assert value(spark, ratings.score(half, "product")) == 0.5
    assert value(spark, ratings.score(half, "min")) == 0.5
    odd = F.from_json(F.lit('[{"rating":"great"},{"rating":"odd"}]'), "array<struct<idx:int,rating:string>>")
    assert value(spark, ratings.step_grades(odd)) is None
    empty = F.from_json(F.lit("[]"), "array<struct<idx:int,rating:string>>")
    assert value(spark, ratings.score(ratings.step_grades(empty), "mean")) is None


def test_template(spark):
    made = prompts.fill(F.lit("a {x} {{'0': p}} {y}"), {"x": F.lit("{y}"), "y": F.lit(2)})
    assert value(spark, made) == "a {y} {'0': p} 2"
    assert value(spark, prompts.fill(F.lit("{x}"), {"x": F.lit(None)})) is None
    assert value(spark, prompts.fill(F.lit("{z}"), {"x": F.lit(1)})) is None
    assert value(spark, prompts.fill(F.lit("plain"), {"x": F.lit(1)})) == "plain"


def test_uniform_numbers(spark):
    assert value(spark, rng.uniform("7")) == pytest.approx(0.5589125377591699)
    df = spark.range(20000).select(rng.uniform(F.col("id")).alias("u"))
    row = df.select(F.avg("u").alias("m"), F.min("u").alias("lo"), F.max("u").alias("hi")).first()
    assert abs(row["m"] - 0.5) < 0.01 and row["lo"] >= 0 and row["hi"] < 1
    counts = df.groupBy(rng.poisson(F.col("u")).alias("n")).count().collect()
    share = {r["n"]: r["count"] / 20000 for r in counts}
    for n in range(4):
        assert share[n] == pytest.approx(math.exp(-1) / math.factorial(n), abs=0.02)


def test_limits(spark):
    assert value(spark, vectors.max_wasserstein(F.lit(7))) == 6
    assert value(spark, vectors.max_entropy(F.lit(7))) == pytest.approx(math.log(7))
    ends = [1, 0, 0], [0, 0, 1]
    assert value(spark, vectors.wasserstein(*map(array, ends))) == 2


def test_smoothing_and_uniform(spark):
    assert value(spark, vectors.smoothed(array([1, 0]))) == [0.75, 0.25]
    assert value(spark, vectors.uniform(F.lit(4))) == [0.25] * 4


def test_pairs_of_all_vectors_by_loop():
    # The closed form the diversity operator relies on.
    xs = [0.1, 0.1, 0.5, 0.9]
    n = len(xs)
    loop = sum(abs(a - b) for a, b in itertools.combinations(xs, 2))
    assert loop == pytest.approx(sum((2 * i - n + 1) * x for i, x in enumerate(sorted(xs))))

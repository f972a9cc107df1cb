"""Sentence split: what stays whole, and the ratios against plain arithmetic."""

import collections
import math
import re

import pytest

from dissensus.operators import sentences

PLAIN = [
    "The house is old. It stands by the sea. The wind is loud.",
    "She saw the sea. The rain came. It was late.",
    "We met Dr. No at noon. The talk was short.",
    "Then Dr. Smith came with Mr. Jones. It rained.",
    "Mr. Brown saw Dr. Lee. The end is near.",
    "It costs 3.14 or 2.50 a piece, e.g. at the shop. The price is fair.",
    "They came by car, e.g. from the sea. It was fun.",
    "J. S. Bach wrote it. The piece is long.",
    "Is it so? Yes! The end.",
    # The words that end the others, inside a sentence.
    "The old sea is loud and late at noon, short fun for Smith, Jones, Brown, Lee and No near a fair shop so it rained, came, long and at the end of the piece",
]
TEXTS = PLAIN * 40


@pytest.fixture(scope="module")
def model(spark):
    return sentences.train(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string"))


def cut(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = sentences.split(df, model, ["id"])
    assert found.columns == ["id", "text", "sentences"]
    return [r["sentences"] for r in found.orderBy("id").collect()]


CASES = {
    "We met Dr. No at noon. The talk was short.": ["We met Dr. No at noon.", "The talk was short."],
    "Ask Mr. Smith. It is late.": ["Ask Mr. Smith.", "It is late."],
    "J. S. Bach wrote it.  The piece is long.\n": ["J. S. Bach wrote it.", "The piece is long."],
    "It costs 3.14 now. We pay 2. The rest is free.": ["It costs 3.14 now.", "We pay 2.", "The rest is free."],
    "On the 3. of May it rained.": ["On the 3. of May it rained."],
    "by car, e.g. from the sea. Good.": ["by car, e.g. from the sea.", "Good."],
    '"Is it so?" he said. "Yes!" The end': ['"Is it so?"', "he said.", '"Yes!"', "The end"],
    "Well... it goes on. Then... The end.": ["Well... it goes on.", "Then...", "The end."],
    "It was Dr. The end.": ["It was Dr.", "The end."],
    "": [],
    "   \n": [],
}


def test_abbreviations_initials_and_decimals_stay_whole(spark, model):
    assert {r[0] for r in model.abbreviations.collect()} == {"dr", "mr", "e.g", "j", "s"}
    assert {"the", "it"} <= {r[0] for r in model.starters.collect()}
    assert cut(spark, model, [*CASES, None]) == [*CASES.values(), None]


def test_a_large_model_is_joined(spark, model, monkeypatch):
    monkeypatch.setattr(sentences, "SET_WORDS", 1)
    assert cut(spark, model, [*CASES, None]) == [*CASES.values(), None]


def test_starters_are_joined_only_behind_abbreviations_and_initials(spark, monkeypatch):
    frame = lambda words: spark.createDataFrame([(w,) for w in words], "word string")
    model = sentences.Model(frame(["dr", "mr"]), frame(["the", "it", "she", "then"]))
    texts = [*CASES, None, *PLAIN, "Then Dr. The end. She saw J. It rained. Mr. the end.", "So it was. The end! It rained? She left."]
    whole = cut(spark, model, texts)
    seen, real = [], sentences.F.explode
    monkeypatch.setattr(sentences, "SET_WORDS", 2)
    monkeypatch.setattr(sentences.F, "explode", lambda c: seen.append(c) or real(c))
    assert cut(spark, model, texts) == whole and len(seen) == 1
    last = spark.createDataFrame([(texts[-1],)], "text string").select(sentences.followed(sentences.stretches(sentences.F.col("text"))).alias("__marks"))
    assert last.select(real(seen[0])).count() == 0


def test_without_texts_all_marks_end_sentences(spark):
    model = sentences.train(spark.createDataFrame([], "text string"))
    assert cut(spark, model, ["Ask Dr. No. Now!"]) == [["Ask Dr.", "No.", "Now!"]]


def test_ratios(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    counts = collections.Counter()
    for t in TEXTS:
        for w in t.split():
            counts[w.strip('."!?,').lower()] += 1
    held = {r["word"]: r for r in sentences.occurrences(rows, "text").groupBy("word").agg({"*": "count"}).collect()}
    assert {w: r["count(1)"] for w, r in held.items()} == dict(counts)
    n, k = counts["dr"], 40 * 3
    periods = 40 * sum(w.rstrip('"').endswith(".") for t in PLAIN for w in t.split())
    p = periods / sum(counts.values())
    ratio = -2 * (k * math.log(p) + (n - k) * math.log(1 - p) - k * math.log(0.99))
    words = sentences.occurrences(rows, "text").groupBy("word").agg(
        sentences.F.count(sentences.F.lit(1)).alias("n"), sentences.F.count_if("period").alias("k")
    )
    found = {r["word"]: r["score"] for r in sentences.abbreviation_scores(words).collect()}
    assert n == k and found["dr"] == pytest.approx(ratio * math.exp(-2))


ODD = [
    None, "", " \n\t ", ". ? !", "  \x0bOne two.  \r\n Three four?!  ", "no mark at all", "a.b.c x.y. End", "Dots... go on. Dots... Go on",
    "http://a.b/c?d=e. Next. 3.14. 2. of", "Well… yes. “Dr.” Smith. (Mr.) Jones.  It  ", "x.  The end.  ", "...", "word .", ". word", "É. Été. Ünd so.",
]


def test_counts_and_breaks_are_those_of_single_tokens(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS + ODD * 5)], "id int, text string")
    F = sentences.F
    every = sentences.occurrences(rows, "text")
    plain = every.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if("period").alias("k"))
    assert sorted(map(tuple, sentences.word_counts(rows, "text").collect())) == sorted(map(tuple, plain.collect()))
    # A text is cut behind the tokens with a mark, and nothing of it is lost.
    tokens = rows.select(F.transform(sentences.tokens(F.col("text")), sentences.bare).alias("t"))
    seen = [t for r in tokens.collect() for t in zip(r["t"] or [], [*(r["t"] or [])[1:], None])]
    parts = rows.select("text", sentences.stretches(F.col("text")).alias("parts"))
    found = parts.withColumn("marks", sentences.followed(F.col("parts"))).collect()
    pairs = [(m["token"], m["following"]) for r in found for m in r["marks"] or []]
    able = lambda a, b: b is None or re.search(rf"[.!?…]{sentences.CLOSING}\u2028?$", a)
    assert collections.Counter(pairs) == collections.Counter((a, b) for a, b in seen if able(a, b))
    assert all("".join(r["parts"]) == r["text"].strip(sentences.BLANKS) for r in found if r["text"] is not None)


def test_white_space_before_a_line_separator(spark, model):
    assert cut(spark, model, ["Abc \u2028", "Abc. \u2028 Def."]) == [["Abc\u2028"], ["Abc.", "\u2028 Def."]]


def test_frequent_tokens_are_not_looked_at_one_by_one(spark):
    rows = spark.createDataFrame([("the sea is old. " * 500,)] * 20, "text string")
    plan = sentences.word_counts(rows, "text")._jdf.queryExecution().optimizedPlan().toString()
    # Patterns stand above the first count, not below it.
    below = plan[plan.rindex("Aggregate") :].split("\n", 1)[1]
    assert "RLIKE" in plan and "regexp_replace" in plan
    assert "RLIKE" not in below and "regexp_replace" not in below

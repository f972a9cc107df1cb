"""Sentence split with abbreviations learned from the texts themselves.

Whether a word with a period is an abbreviation follows from how often it has one: a
likelihood ratio compares "as often as any word" with "nearly always" (Kiss and Strunk,
2006), weighed by its length and inner periods. A second ratio finds the words that begin
sentences, after which a break is kept even behind an abbreviation. Both come from counts
of words, so a model is as large as the vocabulary, and splitting adds no shuffle to the
texts as long as the model's words fit in a set.

Patterns are slow, and most tokens are frequent ones without any mark. So words are
counted as they stand before they are looked at, and texts are cut behind the tokens that
hold a mark: only there can a sentence end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissensus.session import written

# White space is that of ASCII.
BLANK = r" \t\n\x0B\f\r"
BLANKS = " \t\n\x0b\f\r"
# Words of a text with the white space after them.
TOKEN = rf"[^{BLANK}]+[{BLANK}]*"
# A text up to the end of a word with a mark, or its rest.
STRETCH = rf"[^.!?…]*+[.!?…][^{BLANK}]*+|[^.!?…]++"
# Marks that may follow the end of a sentence.
CLOSING = r"[\"'”’»)\]]*"
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
# Chance of a period after an abbreviation, and ratios from which a word counts.
ALWAYS, ABBREVIATION, STARTER = 0.99, 0.3, 30.0
# Words that go into a plan as a set; larger models are joined.
SET_WORDS = 20_000


@dataclass
class Model:
    """Tables of one column ``word`` each."""

    abbreviations: DataFrame
    starters: DataFrame


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def stem(token: Column) -> Column:
    """A token in lower case without the marks around it; inner ones stay."""
    return F.lower(F.regexp_replace(token, EDGES, ""))


def bare(token: Column) -> Column:
    return F.regexp_replace(token, r"[ \t\n\x0B\f\r]+$", "")


def has_period(token: Column) -> Column:
    """A single period at the end, marks that close left aside."""
    return F.rlike(token, F.lit(rf"(^|[^.])\.{CLOSING}$"))


def is_marked(token: Column) -> Column:
    """A mark at the end, marks that close left aside."""
    return F.rlike(token, F.lit(rf"[.!?…]{CLOSING}$"))


def is_number(word: Column) -> Column:
    return F.rlike(word, F.lit(r"^[\p{N}.,:/-]+$"))


def is_initial(word: Column) -> Column:
    return (F.char_length(word) == 1) & F.rlike(word, F.lit(r"^\p{L}$"))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """``word, n, k``: how often each word occurs in all, and with a period. Tokens are
    counted as they are written, and only different ones are made words."""
    rows = texts.select(F.explode(F.split(trimmed(F.col(text)), f"[{BLANK}]+")).alias("t"))
    written_as = rows.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    words = written_as.select(stem(F.col("t")).alias("word"), has_period(F.col("t")).alias("period"), "n")
    k = F.coalesce(F.sum(F.when(F.col("period"), F.col("n"))), F.lit(0).cast("long"))
    # A filter on the word itself would be pushed below the first count.
    held = words.groupBy("word").agg(F.sum("n").alias("n"), k.alias("k"), F.bool_or(F.col("word") != "").alias("some"))
    return held.where("some").select("word", "n", "k")


def stretches(text: Column) -> Column:
    """A text cut behind each token that holds a mark; white space goes with what follows."""
    return F.regexp_extract_all(trimmed(text), F.lit(f"({STRETCH})"), F.lit(1))


def first_token(part: Column) -> Column:
    part = F.ltrim(part, F.lit(BLANKS))
    for blank in BLANKS:
        part = F.substring_index(part, blank, 1)
    return part


def last_token(part: Column) -> Column:
    """The last token of a stretch, which has no white space behind it."""
    for blank in BLANKS:
        part = F.substring_index(part, blank, -1)
    return part


def followed(parts: Column) -> Column:
    """The last token of each stretch (``token``), if it may end a sentence or is that of
    the text, with the one that follows it or null, and its place ``i``."""
    lasts = F.transform(parts, lambda x, i: F.struct(last_token(x).alias("token"), i.alias("i")))
    able = F.filter(lasts, lambda x: (x["i"] == F.size(parts) - 1) | is_marked(x["token"]))
    return F.transform(able, lambda x: x.withField("following", first_token(F.get(parts, x["i"] + 1))))


def occurrences(texts: DataFrame, text: str) -> DataFrame:
    """``word, period, next, next_upper``: one row per token."""
    held = texts.select(F.transform(tokens(F.col(text)), bare).alias("t"))
    rows = F.transform(
        "t",
        lambda x, i: F.struct(
            stem(x).alias("word"), has_period(x).alias("period"), stem(F.get("t", i + 1)).alias("next"),
            F.rlike(F.get("t", i + 1), F.lit(r"^[^\p{L}\p{N}]*\p{Lu}")).alias("next_upper"),
        ),
    )
    return held.select(F.inline(rows)).where(F.col("word") != "")


def log_chance(hits: Column, n: Column, p: Column) -> Column:
    """Logarithm of the chance of some hits in n trials; 0 * log 0 counts as 0."""
    some = lambda k, q: F.when(k > 0, k * F.log(q)).otherwise(0.0)
    return some(hits, p) + some(n - hits, 1 - p)


def abbreviation_scores(words: DataFrame) -> DataFrame:
    """``word, n, k, score`` of words that have a period at least once, from ``word, n, k``
    (all and those with a period)."""
    total = words.agg(F.sum("k").alias("__k"), F.sum("n").alias("__n"))
    share = (total.select(F.col("__k") / F.col("__n"))).scalar()
    ratio = -2 * (log_chance(F.col("k"), F.col("n"), share) - log_chance(F.col("k"), F.col("n"), F.lit(ALWAYS)))
    letters = F.char_length(F.replace("word", F.lit("."), F.lit("")))
    periods = F.char_length("word") - letters + 1
    # A long word, and one that is often without a period, needs a higher ratio.
    weighed = ratio * F.exp(-letters) * periods * F.pow(letters.cast("double"), -(F.col("n") - F.col("k")).cast("double"))
    usable = (F.col("k") > 0) & (letters > 0) & ~is_number(F.col("word"))
    return words.where(usable).withColumn("score", weighed)


def starter_scores(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """``word, n, k, score`` of words that follow a break more often than others, from
    ``next, k`` (times after a break) and ``word, n``."""
    joined = pairs.join(words.select("word", "n"), pairs["next"] == words["word"]).where(F.col("n") >= F.col("k"))
    total = words.agg(F.sum("n")).scalar()
    breaks = pairs.agg(F.sum("k")).scalar()
    n, k = F.col("n"), F.col("k")
    after, other = F.col("k") / breaks, (n - k) / (total - breaks)
    plain = n / total
    ratio = -2 * (
        log_chance(k, breaks, plain) + log_chance(n - k, total - breaks, plain)
        - log_chance(k, breaks, after) - log_chance(n - k, total - breaks, other)
    )
    return joined.select("word", "n", "k", F.when(after > plain, ratio).otherwise(0.0).alias("score"))


def train(texts: DataFrame, text: str = "text") -> Model:
    """Abbreviations and sentence starters of some texts; null texts have none.

    The texts are read twice, their words are counted before they are shuffled.
    """
    words = written(word_counts(texts, text), "words")
    abbreviations = written(abbreviation_scores(words).where(F.col("score") >= ABBREVIATION).select("word"), "abbreviations")
    # Sure breaks: a period after a usual word, a capital letter behind it.
    places = texts.select(stretches(F.col(text)).alias("parts")).select(F.inline(followed(F.col("parts"))))
    token, following = F.col("token"), F.col("following")
    places = places.where(has_period(token) & F.rlike(following, F.lit(r"^[^\p{L}\p{N}]*\p{Lu}")))
    places = places.select(stem(token).alias("word"), stem(following).alias("next"))
    follows = places.groupBy("word", "next").agg(F.count(F.lit(1)).alias("k")).join(abbreviations, "word", "left_anti")
    # Looked at once per pair; as a filter it would be pushed below the count.
    usual = (F.col("word") != "") & (F.col("next") != "") & ~is_initial(F.col("word")) & ~is_number(F.col("word"))
    pairs = follows.groupBy("next").agg(F.sum(F.when(usual, F.col("k"))).alias("k")).where("k IS NOT NULL")
    starters = starter_scores(pairs, words).where(F.col("score") >= STARTER).select("word")
    return Model(abbreviations, written(starters, "starters"))


def breaks_after(token: Column, following: Column, abbreviation: Column, starter: Column, word: Column | None = None) -> Column:
    """Whether a sentence ends with a token. ``abbreviation`` says whether the token is a
    known one, ``starter`` whether the following one begins sentences; ``word`` is the
    token's stem, if it is at hand."""
    lower = F.rlike(following, F.lit(r"^[^\p{L}\p{N}]*\p{Ll}"))
    word = stem(token) if word is None else word
    upper_starter = starter & ~lower
    held = F.when(has_period(token), (abbreviation | is_initial(word)) & ~upper_starter | is_number(word) & lower)
    # Dots that trail off go on in small letters.
    trails = F.rlike(token, F.lit(rf"(\.\.|…){CLOSING}$")) & lower
    return is_marked(token) & ~F.coalesce(held, F.lit(False)) & ~trails


def split(texts: DataFrame, model: Model, key: list[str], text: str = "text", name: str = "sentences") -> DataFrame:
    """``texts`` with the sentences of ``text`` as an array, trimmed; null stays null, a
    text without words has none.

    A model of up to SET_WORDS words goes into the plan as a set. The words of a larger
    one are joined to the distinct words of the texts that matter to it, by their ``key``
    (not null, distinct); the result is the same.
    """
    sets = []
    for words in (model.abbreviations, model.starters):
        found = [r[0] for r in words.limit(SET_WORDS + 1).collect()]
        sets.append(found if len(found) <= SET_WORDS else None)
    cut = lambda rows: rows.withColumn("__parts", stretches(F.col(text))).withColumn("__marks", followed(F.col("__parts")))
    rows, known = texts, []
    for i, (words, found) in enumerate(zip((model.abbreviations, model.starters), sets)):
        if found is not None:
            known.append(lambda w, found=found: w.isin(found) if found else F.lit(False))
            continue
        column, side = f"__known_{i}", ("token", "following")[i]
        # Both only matter behind a period, starters only behind an abbreviation or initial.
        short = known[0] if i and sets[0] is not None else lambda w: F.lit(True)
        needed = lambda x: has_period(x["token"]) & (short(stem(x["token"])) | is_initial(stem(x["token"])))
        stems = F.transform(F.filter("__marks", needed), lambda x: stem(x[side]))
        own = cut(texts).select(*key, F.explode(F.array_distinct(stems)).alias("word"))
        held = own.join(words, "word", "left_semi").groupBy(*key).agg(F.collect_set("word").alias(column))
        rows = rows.join(held, key, "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
        known.append(lambda w, column=column: F.array_contains(F.col(column), w))
    # A token's stem is looked at several times.
    named = F.transform("__marks", lambda x: x.withField("word", stem(x["token"])))
    rows = cut(rows).withColumn("__marks", named)
    last = F.size("__parts") - 1

    def ends(x: Column) -> Column:
        token, following, word = x["token"], x["following"], x["word"]
        return (x["i"] == last) | breaks_after(token, following, known[0](word), known[1](stem(following)), word)

    rows = rows.withColumn("__ends", F.transform(F.filter("__marks", ends), lambda x: x["i"]))
    begin = lambda j: F.when(j > 0, F.get("__ends", j - 1) + 1).otherwise(0)
    # The pattern of bare also takes white space in front of a last line separator.
    joined = lambda e, j: F.array_join(F.slice("__parts", begin(j) + 1, e - begin(j) + 1), "")
    whole = F.transform("__ends", lambda e, j: bare(F.ltrim(joined(e, j), F.lit(BLANKS))))
    return rows.withColumn(name, whole).drop("__parts", "__marks", "__ends", "__known_0", "__known_1")

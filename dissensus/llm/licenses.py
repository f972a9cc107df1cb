"""Licence notices in texts, by the places of rare words. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissensus.llm.exactdedup import normalised

# What stands between words: bytes that are neither ASCII letters or digits nor part of
# another character.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A notice. Its phrase must stand in a text in full; the other words around it only
    raise the score."""

    label: str
    before: str
    phrase: str
    after: str = ""
    base: bool = False

    @property
    def words(self) -> list[str]:
        return f"{self.before} {self.phrase} {self.after}".split()

    @property
    def lead(self) -> int:
        return len(self.before.split())

    @property
    def key(self) -> list[str]:
        return self.phrase.split()


# Notices and the phrases they are known by.
TEMPLATES = (
    Template("gpl", "licensed under the", "gnu general public license", base=True),
    Template("apache", "licensed under the", "apache license", base=True),
    Template("cc-by", "licensed under", "cc by", base=True),
    Template("mit", "released under the", "mit license", base=True),
    Template("gpl-2.0", "this program is licensed under the", "gnu general public license version 2"),
    Template("gpl-3.0", "this program is licensed under the", "gnu general public license version 3"),
    Template("lgpl", "licensed under the", "gnu lesser general public license"),
    Template("agpl", "licensed under the", "gnu affero general public license"),
    Template("apache-2.0", "licensed under the", "apache license version 2 0"),
    Template("cc-by-4.0", "licensed under", "cc by 4 0"),
    Template("cc-by-sa", "licensed under", "cc by sa", "4 0"),
    Template("cc-by-nc", "licensed under", "cc by nc", "4 0"),
    Template("cc-by-nd", "licensed under", "cc by nd", "4 0"),
    Template("mit-text", "", "permission is hereby granted free of charge", "to any person obtaining a copy"),
    Template("bsd", "", "redistribution and use in source and binary forms", "with or without modification"),
    Template("mpl", "subject to the terms of the", "mozilla public license", "v 2 0"),
    Template("isc", "", "permission to use copy modify and or distribute this", "for any purpose"),
    Template("unlicense", "this is", "free and unencumbered", "released into the public domain"),
)


def words(text: Column) -> Column:
    return F.array_remove(F.split(normalised(text), BETWEEN), "")


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for t in templates for w in t.key})


def document_counts(docs: DataFrame, text: str = "text", templates=TEMPLATES) -> dict[str, int]:
    """In how many documents each word of the phrases is; as many rows as such words."""
    held = docs.select(F.explode(F.array_intersect(words(F.col(text)), F.lit(vocabulary(templates)))).alias("word"))
    return {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}


def rarest(t: Template, counts: dict[str, int]) -> int:
    """Place, within the phrase, of its word with the highest inverse document frequency."""
    return min(range(len(t.key)), key=lambda i: (counts.get(t.key[i], 0), i))


def _places(t: Template, counts: dict[str, int], hits: Column, found: Column) -> Column:
    """Where a template's phrase stands: the place of its rarest word tells where each
    other word must be."""
    anchor = rarest(t, counts)
    starts = F.transform(F.filter(hits, lambda h: h["word"] == t.key[anchor]), lambda h: h["place"] - anchor)
    there = lambda s: reduce(
        lambda a, b: a & b,
        [F.coalesce(F.get(found, s + i) == w, F.lit(False)) for i, w in enumerate(t.key) if i != anchor],
        s >= 0,
    )
    return F.filter(starts, there)


def _shares(t: Template, found: Column, starts: Column) -> Column:
    """For each place of a template's phrase, the share of the template's words that
    stand where they should."""
    around = [(i - t.lead, w) for i, w in enumerate(t.words) if not t.lead <= i < t.lead + len(t.key)]

    def share(start: Column) -> Column:
        at = lambda i, w: (start + i >= 0) & (F.get(found, F.greatest(start + i, F.lit(0))) == w)
        hits = [F.when(at(i, w), 1).otherwise(0) for i, w in around]
        return reduce(lambda a, b: a + b, hits, F.lit(len(t.key))) / F.lit(float(len(t.words)))

    return F.transform(starts, share)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per document, repeated rows included: ``key, n_words, n_base, first_word,
    last_word, base_labels, labels, score``.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are
    their smallest and largest start (null without one). ``labels`` are those of all
    templates found, sorted and joined by commas; ``score`` is the largest share of a
    template's words that stand in their places (0 without one). Null and empty texts
    have no words. No shuffle: a first pass counts in how many documents the words of
    the phrases are, the second looks each template up by its rarest word.
    """
    counts = document_counts(docs, text, templates)
    anchors = sorted({t.key[rarest(t, counts)] for t in templates})
    source = docs.select(F.col(key).alias("key"), words(F.col(text)).alias("words"))
    found, any_place = F.col("words"), "array<struct<word:string,place:int>>"
    listed = F.transform(found, lambda w, i: F.struct(w.alias("word"), i.alias("place")))
    hits = F.when(
        F.arrays_overlap(found, F.lit(anchors)), F.filter(listed, lambda h: h["word"].isin(anchors))
    ).otherwise(F.array().cast(any_place))
    located = source.withColumn("hits", hits)
    names = [f"t{i}" for i in range(len(templates))]
    located = located.select(
        "key", "words", *[_places(t, counts, F.col("hits"), found).alias(n) for n, t in zip(names, templates)]
    )
    base = F.concat(*[F.col(n) for n, t in zip(names, templates) if t.base])
    label = lambda n, t: F.when(F.size(n) > 0, F.lit(t.label))
    joined = lambda some: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*some)))), ",")
    shares = [F.coalesce(F.array_max(_shares(t, found, F.col(n))), F.lit(0.0)) for n, t in zip(names, templates)]
    return located.select(
        F.col("key").alias(key),
        F.size("words").cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).cast("long").alias("first_word"),
        F.array_max(base).cast("long").alias("last_word"),
        joined([label(n, t) for n, t in zip(names, templates) if t.base]).alias("base_labels"),
        joined([label(n, t) for n, t in zip(names, templates)]).alias("labels"),
        F.greatest(*shares).alias("score"),
    )


def sql(templates=TEMPLATES) -> str:
    """The same over a table ``documents``, trying every place for every template."""
    def places(t: Template) -> str:
        at = " AND ".join(f"coalesce(w[i + {k + 1}] = '{x}', false)" for k, x in enumerate(t.key))
        return f"list_filter(range(len(w)), lambda i: {at})"

    def share(name: str, t: Template) -> str:
        around = [(i - t.lead, x) for i, x in enumerate(t.words) if not t.lead <= i < t.lead + len(t.key)]
        hits = " + ".join(
            [str(len(t.key))] + [f"(CASE WHEN s + {i} >= 0 AND coalesce(w[greatest(s + {i}, 0) + 1] = '{x}', false) THEN 1 ELSE 0 END)" for i, x in around]
        )
        return f"coalesce(list_max(list_transform({name}, lambda s: ({hits}) / {float(len(t.words))}::DOUBLE)), 0.0)"

    names = [f"t{i}" for i in range(len(templates))]
    base = [n for n, t in zip(names, templates) if t.base]
    label = lambda some: "coalesce(list_aggregate(list_sort(list_distinct(list_filter([" + ", ".join(some) + "], lambda x: x IS NOT NULL))), 'string_agg', ','), '')"  # noqa: E731, E501
    marks = [f"CASE WHEN len({n}) > 0 THEN '{t.label}' END" for n, t in zip(names, templates)]
    return f"""
    WITH n AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '{BETWEEN}'), lambda x: x <> '') AS w FROM documents),
    p AS (SELECT doc_id, w, {", ".join(f"{places(t)} AS {n}" for n, t in zip(names, templates))} FROM n),
    b AS (SELECT *, {" || ".join(base)} AS base FROM p)
    SELECT doc_id, len(w) AS n_words, len(base) AS n_base, list_min(base) AS first_word, list_max(base) AS last_word,
           {label([m for m, t in zip(marks, templates) if t.base])} AS base_labels, {label(marks)} AS labels,
           greatest({", ".join(share(n, t) for n, t in zip(names, templates))}) AS score
    FROM b"""

"""Filling text templates, as column expressions.

A template is a text with ``{name}`` placeholders and ``{{``, ``}}`` for plain
braces. Templates come from the user as a table; none is built in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dissensus.functions.vectors import bind

PLACEHOLDER = r"(?<!\{)\{([A-Za-z_][A-Za-z0-9_]*)\}(?!\})"


def fill(template: Column, values: dict[str, Column]) -> Column:
    """The template with every placeholder replaced; null if a value is null.

    The template is cut at its placeholders, so braces inside a value stay as they
    are. A placeholder without a value makes the result null as well.
    """
    pieces = F.transform(
        F.split(template, PLACEHOLDER),
        lambda p: F.replace(F.replace(p, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}")),
    )
    names = F.regexp_extract_all(template, F.lit(PLACEHOLDER), F.lit(1))
    table = F.struct(*[v.cast("string").alias(k) for k, v in values.items()])

    def of(name: Column, t: Column) -> Column:
        out = None
        for k in values:
            out = F.when(name == k, t[k]) if out is None else out.when(name == k, t[k])
        return out

    def joined(t: Column) -> Column:
        filled = F.transform(t["names"], lambda n: of(n, t["values"]))
        text = F.array_join(
            F.zip_with(t["pieces"], filled, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), ""
        )
        return F.when(F.forall(filled, lambda v: v.isNotNull()), text)

    return bind(F.struct(pieces.alias("pieces"), names.alias("names"), table.alias("values")), joined)


def as_json(value: Column) -> Column:
    """Indented JSON of a map, struct or array."""
    return F.to_json(value, {"pretty": "true"})


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def thinking_answer(reasoning: Column, answer: Column) -> Column:
    """Reasoning and answer as one text, the reasoning inside think tags."""
    # Fixed value: the text format that reasoning models are trained with.
    whole = F.format_string("\n<think>\n%s\n</think>\n\n%s\n", reasoning, answer)
    return F.when(reasoning.isNotNull() & answer.isNotNull(), whole)

"""Reading free-text model answers with Spark's own text and JSON functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dissensus.functions import vectors

# Patterns that answers and logs are read with.
FENCE = r"(?s)```json(.*?)```"
BOXED = r"\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"
LOG_LINE = (
    r"INFO (\d{2}-\d{2} \d{2}:\d{2}:\d{2}) .*? Avg prompt throughput: ([\d.]+) tokens/s, "
    r"Avg generation throughput: ([\d.]+) tokens/s, Running: (\d+) reqs, Waiting: (\d+) reqs, "
    r"GPU KV cache usage: ([\d.]+)%, Prefix cache hit rate: ([\d.]+)%"
)
LOG_MODEL = r"model='([^']+)'"

TRAILING_COMMA = r",\s*([\}\]])"

WHITESPACE = " \t\n\r\f\v"

LENIENT_JSON = {
    "allowSingleQuotes": "true",
    "allowUnquotedFieldNames": "true",
    "allowNonNumericNumbers": "true",
    "allowNumericLeadingZeros": "true",
}

ANSWER_WITH_STEPS = "steps array<string>, final_response string"


def trimmed(text: Column) -> Column:
    """The text without white space around it."""
    return F.btrim(text, F.lit(WHITESPACE))


def json_fence(text: Column) -> Column:
    """Text inside the first json code fence, else the text itself."""
    return F.when(F.rlike(text, F.lit(FENCE)), F.regexp_extract(text, FENCE, 1)).otherwise(text)


def outermost(text: Column) -> Column:
    """From the first brace or bracket of a text to the last one; empty if there is none."""
    return F.regexp_extract(text, r"(?s)[\{\[].*[\}\]]", 0)


def parse(text: Column, schema: str) -> Column:
    """Lenient JSON parse of what stands between the outermost braces or brackets.

    What fails is tried again: without trailing commas; from the first brace on, for
    objects, or the first bracket, for lists, where other brackets stand before it; and,
    where an object is cut off, closed as it is or after its last whole pair. Null where
    nothing parses.
    """
    inner = outermost(text)
    read = lambda part: F.from_json(part, schema, LENIENT_JSON)
    tries = [read(inner)]
    tries.append(F.when(F.rlike(inner, F.lit(TRAILING_COMMA)), read(F.regexp_replace(inner, TRAILING_COMMA, "$1"))))
    first, last = ("[", "]") if schema.startswith("array") else ("{", "}")
    at = F.instr(text, first)
    if schema.startswith("array"):
        own = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    else:
        own = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    tries.append(F.when((at > 0) & (own != inner), read(own)))
    if not schema.startswith("array"):
        rest = F.when(at > 0, F.substr(text, at))
        whole = F.regexp_extract(rest, r"(?s)^(.*),", 1)
        ends = ("}", "}}") if schema.count("map") > 1 else ("}",)
        for part in (rest, whole):
            # A text that ends with a brace is not cut off.
            cut = ~F.rlike(rest, F.lit(r"\}\s*$"))
            tries += [F.when(cut, read(F.concat(part, F.lit(end)))) for end in ends]
    return F.coalesce(*tries)


def final_response(text: Column) -> Column:
    """The ``final_response`` of an answer with steps, as text; null if there is none."""
    return parse(text, ANSWER_WITH_STEPS)["final_response"]


def answer_steps(text: Column) -> Column:
    """The ``steps`` of an answer, null if there are none."""
    return parse(text, ANSWER_WITH_STEPS)["steps"]


def soft_label(text: Column) -> Column:
    """A text as map of label to share; null for anything but a JSON object."""
    return parse(text, "map<string,double>")


def soft_label_by_category(text: Column) -> Column:
    return parse(text, "map<string,map<string,double>>")


def int_list(text: Column) -> Column:
    """A text as list of integers, decimals cut; null for any other shape."""
    numbers = parse(text, "array<double>")
    whole = F.transform(numbers, lambda x: x.try_cast("int"))
    # Bound, as each mention of the parse repeats it.
    return vectors.bind(whole, lambda w: F.when(F.forall(w, lambda x: x.isNotNull()), w))


def int_list_by_category(text: Column) -> Column:
    """Category to list of integers; lists with anything else become null."""
    def integer(x: Column) -> Column:
        return F.when(F.rlike(x, F.lit(r"^-?\d+$")), x.try_cast("int"))

    def whole(xs: Column) -> Column:
        return F.when(F.forall(xs, lambda x: integer(x).isNotNull()), F.transform(xs, integer))

    return F.transform_values(parse(text, "map<string,array<string>>"), lambda _, xs: whole(xs))


def number(text: Column) -> Column:
    """A text that is just a number."""
    return F.trim(text).try_cast("double")


def whole_number(text: Column) -> Column:
    """A text read as a number, decimals cut; null if it is none or beyond a bigint."""
    whole = F.when(F.rlike(text, F.lit(r"^\s*[+-]?\d+\s*$")), F.trim(text).try_cast("bigint"))
    return F.coalesce(whole, text.try_cast("double").try_cast("bigint"))


def int_or_text(text: Column) -> Column:
    """A text that is an integer in its plain form, any other text unchanged."""
    return F.coalesce(F.trim(text).try_cast("int").cast("string"), text)


def boxed_answer(text: Column) -> Column:
    """Content of the first ``\\boxed{..}``, with one level of inner braces; else null."""
    return F.when(F.rlike(text, F.lit(BOXED)), F.regexp_extract(text, BOXED, 1))


def n_paragraphs(text: Column) -> Column:
    """Number of parts between blank lines."""
    return F.size(F.split(text, "\n\n"))


def paragraphs(text: Column) -> Column:
    """Non-blank paragraphs as (idx, text), numbered before blank ones are left out."""
    parts = F.transform(
        F.split(text, "\n\n"), lambda s, i: F.struct(i.alias("idx"), s.alias("text"))
    )
    return F.filter(parts, lambda x: F.rlike(x["text"], F.lit(r"\S")))


def sentences(text: Column) -> Column:
    """Sentences of a text with their punctuation, as (text)."""
    parts = F.filter(
        F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: F.rlike(s, F.lit(r"\S"))
    )
    return F.transform(parts, lambda s: F.struct(s.alias("text")))


def first_part(parts: Column, thought: bool) -> Column:
    """Text of the first thought, or first non-thought, part of a response."""
    def matches(p: Column) -> Column:
        is_thought = F.coalesce(p["thought"], F.lit(False))
        return is_thought if thought else ~is_thought

    return F.get(F.filter(parts, matches), F.lit(0))["text"]


def log_fields(line: Column) -> list[Column]:
    """Typed columns of a throughput log line; null where the line is of another kind."""
    def field(i: int, kind: str) -> Column:
        return F.regexp_extract(line, LOG_LINE, i).try_cast(kind)

    # The log has no year: 1900 stands in for it, as a plain date parser does.
    stamp = F.concat(F.lit("1900-"), F.regexp_extract(line, LOG_LINE, 1))
    return [
        F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        field(2, "double").alias("prompt_throughput"),
        field(3, "double").alias("generation_throughput"),
        field(4, "int").alias("running_requests"),
        field(5, "int").alias("waiting_requests"),
        field(6, "double").alias("gpu_cache_usage"),
        field(7, "double").alias("prefix_cache_hit_rate"),
    ]


def log_model(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, LOG_MODEL, 1), F.lit(""))

"""The language of texts and pages, from several kinds of evidence.

The likelihood of a text under each language is joined, as Bayes' rule says, with that
of the language its markup declares and of the suffix of its address, and with a prior
for its host. Host priors, and how reliable declarations and suffixes are, come from
grouped sums of what the texts alone say, without the row that is judged. A host with
few rows leans on its domain, a domain on all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from dissensus.llm import words as W
from dissensus.llm.urlfilter import parts
from dissensus.session import configure, written

BUCKETS = 1 << 15  # hashed runs of three bytes
MAX_COLUMNS = 200  # languages with one column each; more of them are numbers in one array
MAX_LANGUAGES = 8192  # of a model, which is sent to all tasks: 128 kB each
NUMBERS = 1 << 24  # of an array over rows and languages at a time
SMOOTHING = 0.5
# Rows that a level of the hierarchy counts for in the level below.
PRIOR_ROWS = 5.0
KINDS_ROWS = 2.0
MARKUP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>"


@dataclass
class Model:
    """Logarithms of the probabilities of byte runs, by language."""

    languages: list[str]
    table: np.ndarray  # (BUCKETS + 1, languages); the last row is zero

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log likelihoods per text: the mean over its byte runs times the square root of
        their number, as neighbouring runs say much the same."""
        n = len(offsets) - 1
        out = np.zeros((n, len(self.languages)))
        at = grams(data, offsets)
        step = max(1, NUMBERS // max(1, len(self.languages)))
        for lo in range(0, len(at), step):
            # Texts with bytes in this part; the first may have begun before it.
            hi = min(lo + step, len(at))
            some = np.flatnonzero((np.diff(offsets) > 0) & (offsets[1:] > lo) & (offsets[:-1] < hi))
            out[some] += np.add.reduceat(self.table[at[lo:hi]], np.maximum(offsets[some] - lo, 0), axis=0)
        count = np.maximum(1, np.diff(offsets) - 2)
        return out / np.sqrt(count)[:, None]


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A bucket per byte: of the run of three bytes that begins there, or BUCKETS near the
    end of a text. ASCII bytes that are not in words count as blanks."""
    low = np.where(W.LOWER[data] == 0, 32, W.LOWER[data]).astype(np.uint32)
    padded = np.append(low, [0, 0]).astype(np.uint32)
    code = (padded[:-2] << 16) | (padded[1:-1] << 8) | padded[2:]
    at = ((code * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int64)
    ends = offsets[1:][np.diff(offsets) > 0]
    at[ends - 1] = BUCKETS
    at[np.maximum(ends - 2, 0)] = BUCKETS
    return at


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts of byte runs by language over all rows with a language.

    What comes to the driver is bounded by BUCKETS and the number of languages; more
    than MAX_LANGUAGES of them are an error. Without any the model knows no language.
    """
    source = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    source = source.filter("lang IS NOT NULL AND text IS NOT NULL")

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = W.utf8(batch.column("text"))
            codes = batch.column("lang").dictionary_encode()
            names, which = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            for lo, hi in W.chunks(offsets):
                mine = offsets[lo : hi + 1] - offsets[lo]
                at = grams(data[offsets[lo] : offsets[hi]], mine)
                whose = np.repeat(which[lo:hi], np.diff(mine))
                flat = np.bincount(whose * (BUCKETS + 1) + at, minlength=len(names) * (BUCKETS + 1))
                for i, name in enumerate(names):
                    counts[name] = counts.get(name, 0) + flat[i * (BUCKETS + 1) : (i + 1) * (BUCKETS + 1)]
        for name, found in counts.items():
            at = np.flatnonzero(found[:BUCKETS])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(found[at].astype(np.int64))],
                names=["lang", "bucket", "n"],
            )

    counted = source.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = written(counted, "byte-runs")
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.full((BUCKETS, len(languages)), SMOOTHING)
    place = {name: i for i, name in enumerate(languages)}
    for row in counted.toLocalIterator():
        table[row["bucket"], place[row["lang"]]] += row["n"]
    table /= table.sum(axis=0)
    np.log(table, out=table)
    return Model(languages, np.concatenate([table, np.zeros((1, len(languages)))]).astype(np.float32))


def page_evidence(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, text, declared, suffix, host, domain`` of web pages."""
    markup = F.col(html).cast("string")
    host, path = parts(F.col(url).cast("string"))
    declared = F.lower(F.regexp_extract(markup, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    folder = F.regexp_extract(path, r"^/([A-Za-z]{2})(?:/|$)", 1)
    names = F.split(host, r"\.")
    return pages.select(
        F.col(key).alias("key"),
        F.regexp_replace(F.coalesce(markup, F.lit("")), MARKUP, " ").alias("text"),
        F.when(declared != "", declared).alias("declared"),
        F.when(host != "", F.concat_ws("/", F.element_at(names, -1), F.lower(folder))).alias("suffix"),
        F.when(host != "", host).alias("host"),
        F.when(host != "", F.array_join(F.slice(names, F.greatest(F.size(names) - 1, F.lit(1)), 2), ".")).alias("domain"),
    )


def text_evidence(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The same of plain texts: where they come from stands for the host."""
    origin = F.col(source).cast("string") if source in docs.columns else F.lit(None).cast("string")
    nothing = F.lit(None).cast("string")
    return docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        nothing.alias("declared"), nothing.alias("suffix"), origin.alias("host"), origin.alias("domain"),
    )


def normal(logs: list[Column]) -> list[Column]:
    """Probabilities from logarithms."""
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    parts_ = [F.exp(x - top) for x in logs]
    total = sum(parts_[1:], parts_[0])
    return [p / total for p in parts_]


def identify(rows: DataFrame, model: Model) -> DataFrame:
    """``key, lang, score, text_lang, declared, host`` of rows of evidence.

    ``lang`` has the largest probability, ``score``, given all evidence; ``text_lang``
    given the text alone (null for texts of less than three bytes). Evidence that is
    null says nothing: a row without any has the language most rows have. Ties go to the
    first language in order. Repeated rows and null keys are kept. A model without
    languages gives null and 0. With more than MAX_COLUMNS languages the same is worked
    out on arrays (``identify_many``).
    """
    configure(rows.sparkSession)
    if not model.languages:
        empty = F.lit(None).cast("string")
        return rows.select("key", empty.alias("lang"), F.lit(0.0).alias("score"), empty.alias("text_lang"), "declared", "host")
    n = len(model.languages)
    if n > MAX_COLUMNS:
        return identify_many(rows, model)
    logs, ps = [f"l{i}" for i in range(n)], [f"p{i}" for i in range(n)]
    kept = ["key", "declared", "suffix", "host", "domain"]
    schema = rows.select(*kept).schema.add("known", "boolean")
    for name in logs:
        schema = schema.add(name, "double")
    # Bounded by BUCKETS and MAX_LANGUAGES.
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            data, offsets = W.utf8(batch.column("text"))
            for lo, hi in W.chunks(offsets):
                mine = offsets[lo : hi + 1] - offsets[lo]
                found = shared.value.evidence(data[offsets[lo] : offsets[hi]], mine)
                columns = [batch.column(c).slice(lo, hi - lo) for c in kept]
                known = pa.array(np.diff(mine) > 2)
                yield pa.RecordBatch.from_arrays([*columns, known, *map(pa.array, found.T)], names=[*kept, "known", *logs])

    said = rows.select(*kept, "text").mapInArrow(run, schema)
    said = said.withColumns(dict(zip(ps, normal([F.col(x) for x in logs]))))
    said = written(said, "text-evidence")
    # A text that says nothing adds nothing to the sums.
    share = lambda p: F.when(F.col("known"), F.col(p)).otherwise(0.0)
    # One number per language.
    every = said.agg(*[F.coalesce(F.sum(share(p)), F.lit(0.0)).alias(p) for p in ps]).first()
    joined = said.withColumns({f"all_{p}": F.lit(every[p]) for p in ps})
    for level in ("declared", "suffix", "host", "domain"):
        sums = said.filter(F.col(level).isNotNull()).groupBy(level).agg(*[F.sum(share(p)).alias(f"{level}_{p}") for p in ps])
        # Rows without a value match nothing; numbers spread them over the tasks.
        spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64("key", *logs), F.lit(1 << 16)).cast("string"))
        joined = joined.withColumn("at", F.coalesce(level, spread)).join(sums.withColumnRenamed(level, "at"), "at", "left").drop("at")
    total = lambda prefix: sum((F.col(f"{prefix}_{p}") for p in ps[1:]), F.col(f"{prefix}_{ps[0]}"))
    # Without the row itself. Sums of doubles may end just below zero.
    others = lambda prefix, p: F.greatest(F.col(f"{prefix}_{p}") - share(p), F.lit(0.0))
    others_total = lambda prefix: F.greatest(total(prefix) - F.when(F.col("known"), 1.0).otherwise(0.0), F.lit(0.0))
    posterior = []
    for log, p in zip(logs, ps):
        overall = (others("all", p) + 1.0) / (others_total("all") + float(n))
        prior = overall
        for level in ("domain", "host"):
            narrow = (others(level, p) + F.lit(PRIOR_ROWS) * prior) / (others_total(level) + F.lit(PRIOR_ROWS))
            prior = F.coalesce(narrow, prior)
        at = F.col(log) + F.log(prior)
        for kind in ("declared", "suffix"):
            # How much likelier the value is in this language than at large.
            likely = (others(kind, p) + F.lit(KINDS_ROWS) * overall) / (others_total(kind) + F.lit(KINDS_ROWS)) / overall
            at = at + F.coalesce(F.log(likely), F.lit(0.0))
        posterior.append(at)
    final = joined.withColumns({f"q{i}": c for i, c in enumerate(posterior)})
    final = final.withColumns({f"r{i}": c for i, c in enumerate(normal([F.col(f"q{i}") for i in range(n)]))})

    def best(prefix):
        top = F.greatest(*[F.col(f"{prefix}{i}") for i in range(n)]) if n > 1 else F.col(f"{prefix}0")
        return F.coalesce(*[F.when(F.col(f"{prefix}{i}") == top, F.lit(name)) for i, name in enumerate(model.languages)]), top

    lang, score = best("r")
    alone, _ = best("p")
    return final.select(
        "key", lang.alias("lang"), score.alias("score"), F.when(F.col("known"), alone).alias("text_lang"), "declared", "host"
    )


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The lists of a column as rows; null ones are not numbers."""
    out = np.full((len(column), width), np.nan)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    out[there] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def shares(logs: np.ndarray) -> np.ndarray:
    """Probabilities from logarithms, by row."""
    found = np.exp(logs - logs.max(axis=1, keepdims=True))
    return found / found.sum(axis=1, keepdims=True)


def identify_many(rows: DataFrame, model: Model) -> DataFrame:
    """``identify`` for any number of languages: an array per row instead of columns.

    The sums of a declared language, suffix, host or domain are one row per language
    until they are whole. Tasks add up what a batch says of a value before that, so a
    value that many rows have costs a few rows a batch.
    """
    n, languages = len(model.languages), np.array(model.languages, dtype=object)
    levels = ["declared", "suffix", "host", "domain"]
    kept = ["key", *levels]
    few = max(1, NUMBERS // n)  # rows at a time
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def lists(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * n, pa.int32()), pa.array(values.ravel()))

    def read(batches):
        for batch in batches:
            data, offsets = W.utf8(batch.column("text"))
            for start, end in W.chunks(offsets):
                for lo in range(start, end, few):
                    hi = min(lo + few, end)
                    mine = offsets[lo : hi + 1] - offsets[lo]
                    found = shared.value.evidence(data[offsets[lo] : offsets[hi]], mine)
                    columns = [batch.column(c).slice(lo, hi - lo) for c in kept]
                    known = pa.array(np.diff(mine) > 2)
                    yield pa.RecordBatch.from_arrays([*columns, known, lists(found)], names=[*kept, "known", "logs"])

    def slices(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, few):
                yield batch.slice(lo, few)

    def said_by_text(batch) -> np.ndarray:
        known = batch.column("known").to_numpy(zero_copy_only=False)
        return shares(matrix(batch.column("logs"), n)) * known[:, None]

    def add_up(batches):
        for batch in slices(batches):
            said = said_by_text(batch)
            for level in ["all", *levels]:
                values = pa.array([""] * len(said)) if level == "all" else batch.column(level)
                codes = values.dictionary_encode()
                which = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                order = np.argsort(which, kind="stable")
                order = order[which[order] >= 0]
                if not len(order):
                    continue
                begins = np.flatnonzero(np.diff(which[order], prepend=-1))
                sums = np.add.reduceat(said[order], begins, axis=0)
                names = codes.dictionary.take(pa.array(which[order][begins]))
                yield pa.RecordBatch.from_arrays([pa.array([level] * len(names)), names, lists(sums)], names=["level", "at", "sums"])

    schema = rows.select(*kept).schema.add("known", "boolean").add("logs", ArrayType(DoubleType()))
    said = written(rows.select(*kept, "text").mapInArrow(read, schema), "text-evidence")
    sums = said.mapInArrow(add_up, "level string, at string, sums array<double>")
    sums = sums.select("level", "at", F.posexplode("sums").alias("i", "p")).groupBy("level", "at", "i").agg(F.sum("p").alias("p"))
    # A list has one entry per language.
    sums = sums.groupBy("level", "at").agg(F.array_sort(F.collect_list(F.struct("i", "p"))).alias("sums"))
    sums = written(sums.select("level", "at", F.col("sums.p").alias("sums")), "evidence-sums")
    row = sums.filter("level = 'all'").select("sums").first()
    every = np.array(row["sums"] if row else [0.0] * n)
    joined = said
    for level in levels:
        mine = sums.filter(F.col("level") == level).select("at", F.col("sums").alias(f"{level}_sums"))
        # Rows without a value match nothing; numbers spread them over the tasks.
        spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64("key", "logs"), F.lit(1 << 16)).cast("string"))
        joined = joined.withColumn("at", F.coalesce(level, spread)).join(mine, "at", "left").drop("at")

    def judge(batches):
        for batch in slices(batches):
            logs = matrix(batch.column("logs"), n)
            known = batch.column("known").to_numpy(zero_copy_only=False)
            said = said_by_text(batch)

            def others(found):
                """Sums without the row itself, which may end just below zero."""
                return np.maximum(found - said, 0.0), np.maximum(found.sum(axis=1) - known, 0.0)[:, None]

            mine, total = others(np.broadcast_to(every, said.shape))
            overall = (mine + 1.0) / (total + n)
            prior = overall
            for level in ("domain", "host"):
                mine, total = others(matrix(batch.column(f"{level}_sums"), n))
                narrow = (mine + PRIOR_ROWS * prior) / (total + PRIOR_ROWS)
                prior = np.where(np.isnan(narrow), prior, narrow)
            at = logs + np.log(prior)
            for kind in ("declared", "suffix"):
                mine, total = others(matrix(batch.column(f"{kind}_sums"), n))
                likely = np.log((mine + KINDS_ROWS * overall) / (total + KINDS_ROWS) / overall)
                at += np.where(np.isnan(likely), 0.0, likely)
            final = shares(at)
            alone = np.where(known, languages[logs.argmax(axis=1)], None)
            columns = [batch.column("key"), pa.array(languages[final.argmax(axis=1)], pa.string()), pa.array(final.max(axis=1))]
            columns += [pa.array(alone, pa.string()), batch.column("declared"), batch.column("host")]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "lang", "score", "text_lang", "declared", "host"])

    out = rows.select("key").schema.add("lang", "string").add("score", "double").add("text_lang", "string")
    return joined.mapInArrow(judge, out.add("declared", "string").add("host", "string"))

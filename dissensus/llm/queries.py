"""The operators bound to the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import dissensus
from dissensus.llm import licenses

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId not in SHIPPED:
        package = Path(dissensus.__file__).parent
        into = Path(tempfile.mkdtemp(prefix="run-")) / "dissensus.zip"
        with zipfile.ZipFile(into, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(into))
        SHIPPED.add(context.applicationId)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_near_duplicates")
def op1(spark, folder):
    from dissensus.llm import minhash

    return minhash.classes(table(spark, folder, "documents"))


@query("op2_language")
def op2(spark, folder):
    """The language of every page and of every document, in one table."""
    from dissensus.llm import langid

    docs, pages = table(spark, folder, "documents"), table(spark, folder, "pages")
    model = langid.train(docs)
    which = lambda name: F.struct(F.lit(name).alias("table"), F.col("key").alias("id")).alias("key")
    rest = ["text", "declared", "suffix", "host", "domain"]
    rows = langid.page_evidence(pages).select(which("pages"), *rest)
    rows = rows.unionByName(langid.text_evidence(docs).select(which("documents"), *rest))
    of = lambda name: F.when(F.col("key")["table"] == name, F.col("key")["id"])
    found = langid.identify(rows, model)
    return found.select(of("documents").alias("doc_id"), of("pages").alias("page_id"), *found.columns[1:])


@query("op3_benchmark_passages")
def op3(spark, folder):
    from dissensus.llm import decontaminate

    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


# Fixed values of the query.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


@query(
    "op4_url_filter",
    """
    WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    c AS (SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') AS canon FROM p),
    l AS (SELECT canon FROM c WHERE canon <> '' GROUP BY canon HAVING count(*) > 1),
    r AS (SELECT * FROM (VALUES %s) r(verdict, rule)),
    f AS (SELECT host, path, min({'n': -length(rule), 'k': rule, 'v': verdict}) AS best
          FROM (SELECT DISTINCT host, path FROM p) d JOIN r
            ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
           AND starts_with(path, rule[instr(rule, '/'):])
          GROUP BY host, path)
    SELECT c.page_id, c.host, c.path, f.best.k AS rule,
           coalesce(f.best.v, CASE WHEN l.canon IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
           l.canon IS NOT NULL AS listed
    FROM c LEFT JOIN f ON c.host = f.host AND c.path = f.path LEFT JOIN l ON c.canon = l.canon
    """
    % ", ".join(map(str, RULES)),
)
def op4(spark, folder):
    from dissensus.llm import urlfilter

    pages = table(spark, folder, "pages")
    return urlfilter.judge(pages, urlfilter.rule_table(spark, RULES), urlfilter.repeated(pages))


@query("op5_license_scan", licenses.sql())
def op5(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


@query("op6_toxicity")
def op6(spark, folder):
    from dissensus.llm import toxicity

    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        (toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "threshold",
        "toxic",
    )


@query("op7_token_files")
def op7(spark, folder):
    from dissensus.llm import tokenfiles

    return tokenfiles.corpus(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), added=True)


@query("op8_bpe_round_trip")
def op8(spark, folder):
    from dissensus.llm import bpe

    return bpe.digests(table(spark, folder, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


@query(
    "op9_exact_duplicates",
    """
    WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
               FROM documents),
    g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)
    """,
)
def op9(spark, folder):
    from dissensus.llm import exactdedup

    return exactdedup.groups(table(spark, folder, "documents"))


@query("op10_warc_index")
def op10(spark, folder):
    from dissensus.llm import warc

    return warc.archive(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "part", "place", "capture"
    )


@query("op11_token_alignment")
def op11(spark, folder):
    from dissensus.llm import align

    return align.align(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query("op12_packed_sequences")
def op12(spark, folder):
    from dissensus.llm import packing

    return packing.pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


@query(
    "op13_ranked_search",
    r"""
    WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM low),
    d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
    s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM d),
    f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
    w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM f, s GROUP BY term, docs),
    q AS (SELECT item_id, term, count(*) AS qf FROM (
              SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
          GROUP BY item_id, term),
    m AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // words AS m FROM d, s),
    g AS (SELECT item_id, doc_id, sum(qf * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
          FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM g WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
    """,
)
def op13(spark, folder):
    from dissensus.llm import lexical

    return lexical.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))

"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dissensus import registry
from dissensus.functions import prompts, ratings, text, vectors
from dissensus.operators import agreement, metrics, sentences
from dissensus.sources import answers as answer_source
from dissensus.sources import items as item_source
from dissensus.sources import logs
from workloads.base import long_vector, query, r6, rounded, view

KEY = ["dataset", "split", "rid"]


@query(
    "answer_wasserstein", "P28 P33 P34 P12",
    """SELECT dataset, split, rid, round(ws_loss, 6) AS ws_loss, round(ws_loss / (n_classes - 1), 6) AS normed_ws_loss,
              round(pred_entropy, 6) AS pred_entropy FROM scored""",
)
def _(t):
    return rounded(t.scored.select(*KEY, "ws_loss", "normed_ws_loss", "pred_entropy"))


@query(
    "mean_wasserstein_rounded", "P29",
    "SELECT round(avg(ws_loss), 5) AS average_ws FROM scored",
)
def _(t):
    return metrics.average_wasserstein(t.pairs)


@query(
    "answer_vector_distance", "P30",
    "SELECT dataset, split, rid, round(avg(abs(target - p)), 6) AS l0_loss FROM pairs GROUP BY ALL",
)
def _(t):
    return rounded(metrics.with_l0(t.pairs).select(*KEY, "l0_loss"))


@query(
    "smoothed_vectors", "P25",
    "SELECT dataset, split, rid, class_idx, round((p + 1.0 / n_classes) / 2, 6) AS prob FROM soft",
)
def _(t):
    df = t.soft.withColumn("pred", vectors.smoothed(F.col("pred")))
    return long_vector(df, KEY)


@query(
    "uniform_vectors", "P26",
    """SELECT DISTINCT l.dataset, k.k AS class_idx, round(1.0 / n_classes, 6) AS prob
       FROM labelled l, range(11) k(k) WHERE k.k < n_classes""",
)
def _(t):
    df = t.labelled.select("dataset", "n_classes").distinct()
    return long_vector(df.withColumn("pred", vectors.uniform(F.col("n_classes"))), ["dataset"])


@query(
    "dataset_limits", "P27 A3 P4 P36",
    """SELECT DISTINCT dataset, CASE dataset WHEN 'Paraphrase' THEN 'PAR' ELSE dataset END AS short_name, n_classes,
              CASE dataset WHEN 'CSC' THEN 6 ELSE n_classes END AS used_classes,
              (n_classes - 1)::DOUBLE AS max_ws, round(ln(n_classes), 6) AS max_entropy FROM labelled""",
)
def _(t):
    name = F.col("dataset")
    n = registry.n_classes(name)
    return rounded(
        t.answers.select("dataset").distinct().select(
            "dataset",
            registry.short_name(name).alias("short_name"),
            n.alias("n_classes"),
            registry.n_classes(name, 6).alias("used_classes"),
            vectors.max_wasserstein(n).alias("max_ws"),
            vectors.max_entropy(n).alias("max_entropy"),
        )
    )


@query(
    "target_holes_and_entropy", "P10 P11",
    """SELECT dataset, split, dataset_idx,
              max(n_classes) > 2 AND coalesce(max(class_idx) FILTER (target > 0) - min(class_idx) FILTER (target > 0) + 1
                                              > count(*) FILTER (target > 0), false) AS tgt_has_holes,
              round(-sum(CASE WHEN target > 0 THEN target * ln(target) ELSE 0 END), 6) AS target_entropy
       FROM targets GROUP BY dataset, split, dataset_idx""",
)
def _(t):
    df = metrics.with_target_columns(t.targets)
    return rounded(df.select("dataset", "split", "dataset_idx", "tgt_has_holes", "target_entropy"))


@query(
    "embedding_entropy", "P11 P28",
    """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
     n AS (SELECT vec_id, label, i, abs(x) / sum(abs(x)) OVER (PARTITION BY vec_id) AS p, 1.0 / count(*) OVER (PARTITION BY vec_id) AS u FROM e),
     c AS (SELECT *, sum(p - u) OVER (PARTITION BY vec_id ORDER BY i) AS gap FROM n)
     SELECT vec_id, label, round(-sum(p * ln(p)), 6) AS entropy, round(sum(abs(gap)), 6) AS ws_to_uniform FROM c GROUP BY ALL""",
)
def _(t):
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    df = t.embeddings.select("vec_id", "label", v.alias("v"))
    return rounded(
        df.select(
            "vec_id",
            "label",
            vectors.entropy(F.col("v")).alias("entropy"),
            vectors.wasserstein(F.col("v"), vectors.uniform(F.size("v"))).alias("ws_to_uniform"),
        )
    )


@query(
    "annotator_distance_rows", "P31 P32 P35",
    """SELECT dataset, split, rid, pred = target AS correct, round(abs(pred - target) / (n_classes - 1)::DOUBLE, 6) AS abs_dist
       FROM labelled""",
)
def _(t):
    return rounded(metrics.label_distance(t.labelled).select(*KEY, "correct", "abs_dist"))


# Two or three labels per answer as aligned lists, made from the columns of the row.
@view(
    "label_lists",
    """SELECT dataset, split, dataset_idx, run_idx, rid, n_classes, CASE WHEN t < 6 THEN [a, b, c] ELSE [a, b] END AS preds,
              CASE WHEN t < 6 OR d = 0 THEN [b, c, a] ELSE [b, c] END AS targets, 3::INTEGER AS n_annotators
       FROM (SELECT *, CASE dataset WHEN 'CSC' THEN 1 + d % 6 WHEN 'MP' THEN d % 2 ELSE d - 5 END AS a,
                    CASE dataset WHEN 'CSC' THEN 1 + t % 6 WHEN 'MP' THEN t % 2 ELSE t - 4 END AS b,
                    CASE dataset WHEN 'CSC' THEN 1 + q % 6 WHEN 'MP' THEN q % 2 ELSE q % 11 - 5 END AS c FROM labelled)""",
)
def label_lists(t):
    def label(c, shift, span):
        x, name = F.col(c), F.col("dataset")
        return F.when(name == "CSC", 1 + x % 6).when(name == "MP", x % 2).otherwise(x % span - shift)

    a, b, c = label("d", 5, 11), label("t", 4, 9), label("q", 5, 11)
    three = F.col("t") < 6
    return t.labelled.select(
        "dataset", "split", "dataset_idx", "run_idx", "rid", "n_classes",
        F.when(three, F.array(a, b, c)).otherwise(F.array(a, b)).alias("pred"),
        F.when(three | (F.col("d") == 0), F.array(b, c, a)).otherwise(F.array(b, c)).alias("target"),
        F.lit(3).alias("n_annotators"),
    )


@query(
    "list_distance", "P31 P32",
    """SELECT dataset, split, rid, CASE WHEN len(preds) = len(targets) THEN
              round(list_avg(list_transform(range(1, len(preds) + 1), lambda i: abs(preds[i] - targets[i])::DOUBLE)) / (n_classes - 1), 6) END AS avg_abs_dist
       FROM label_lists""",
)
def _(t):
    return rounded(metrics.with_abs_dist(t.label_lists).select(*KEY, "avg_abs_dist"))


@query(
    "list_shares", "P24",
    """SELECT dataset, split, rid, k.k AS class_idx,
              round(len(list_filter(preds, lambda x: x + (CASE dataset WHEN 'Paraphrase' THEN 5 ELSE 0 END) = k.k)) / len(preds)::DOUBLE, 6) AS prob
       FROM label_lists, range(11) k(k) WHERE k.k < n_classes""",
)
def _(t):
    name = F.col("dataset")
    indexes = F.transform("pred", lambda x: registry.class_index(name, x))
    df = t.label_lists.withColumn("pred", vectors.shares(indexes, F.col("n_classes")))
    return long_vector(df, KEY)


@query(
    "annotation_moments", "P45",
    """SELECT dataset, split, rid, round(list_avg(preds), 6) AS mean, round(list_var_pop(preds), 6) AS variance
       FROM label_lists""",
)
def _(t):
    v = F.transform("pred", lambda x: x.cast("double"))
    return rounded(
        t.label_lists.select(*KEY, vectors.mean(v).alias("mean"), vectors.variance(v).alias("variance"))
    )


@query(
    "class_differences", "P51",
    "SELECT dataset, split, rid, class_idx AS class, target, round(p, 6) AS pred, round(abs(target - p), 6) AS abs_diff FROM "
    "(SELECT dataset, split, rid, class_idx, round(target, 6) AS target, p FROM pairs)",
)
def _(t):
    df = t.pairs.withColumn("target", vectors.rounded(F.col("target"), 6))
    return rounded(metrics.class_differences(df, KEY))


# --- free text ----------------------------------------------------------------------

# Answers as text: fenced, with single quotes, with a forbidden key, cut off, blank.
@view(
    "responses",
    """
    SELECT *, CASE WHEN t = 8 THEN NULL
      WHEN t = 7 THEN '   '
      WHEN t = 6 THEN 'cut {"' || l1 || '": 0.' || lpad(CAST(m1 AS VARCHAR), 2, '0')
      WHEN t = 5 THEN '{"nine": 1.0}'
      WHEN t = 4 THEN '{' || chr(39) || l1 || chr(39) || ': ' || CAST(m1 / 100.0::DOUBLE AS VARCHAR) || '}'
      WHEN t = 3 THEN E'Here:\\n```json\\n' || body || E'\\n```\\nDone'
      ELSE body END AS response,
      CASE WHEN q <= 2 THEN NULL ELSE q % 10 <> 0 END AS success
    FROM (SELECT *, '{"' || l1 || '": ' || CAST(p1 / 100.0::DOUBLE AS VARCHAR) || ', "' || l2 || '": ' || CAST(p2 / 100.0::DOUBLE AS VARCHAR) || '}' AS body
          FROM (SELECT *, CAST(k1 - off AS VARCHAR) AS l1, CAST(k2 - off AS VARCHAR) AS l2 FROM
                (SELECT *, CASE WHEN dataset = 'CSC' THEN 1 + (q - 1) % 5 WHEN dataset = 'MP' THEN 0 ELSE d % 10 END AS k1,
                           CASE WHEN dataset = 'CSC' THEN 6 WHEN dataset = 'MP' THEN 1 ELSE 10 END AS k2,
                           100 - 9 * d AS p1, 9 * d + (CASE WHEN q = 13 THEN 3 ELSE 0 END) AS p2 FROM masses)))
    """,
)
def responses(t):
    name, d, q, tax = F.col("dataset"), F.col("d"), F.col("q"), F.col("t")
    csc, mp = name == "CSC", name == "MP"
    off = F.when(name == "Paraphrase", 5).otherwise(0)
    df = t.masses.withColumns(
        {
            "k1": F.when(csc, 1 + (q - 1) % 5).when(mp, 0).otherwise(d % 10),
            "k2": F.when(csc, 6).when(mp, 1).otherwise(10),
            "p1": 100 - 9 * d,
            "p2": 9 * d + F.when(q == 13, 3).otherwise(0),
        }
    ).withColumns({"l1": (F.col("k1") - off).cast("string"), "l2": (F.col("k2") - off).cast("string")})
    share = lambda c: (F.col(c) / F.lit(100.0)).cast("string")
    body = F.concat(
        F.lit('{"'), "l1", F.lit('": '), share("p1"), F.lit(', "'), "l2", F.lit('": '), share("p2"), F.lit("}")
    )
    response = (
        F.when(tax == 8, F.lit(None).cast("string"))
        .when(tax == 7, "   ")
        .when(tax == 6, F.concat(F.lit('cut {"'), "l1", F.lit('": 0.'), F.lpad(F.col("m1").cast("string"), 2, "0")))
        .when(tax == 5, '{"nine": 1.0}')
        .when(tax == 4, F.concat(F.lit("{'"), "l1", F.lit("': "), share("m1"), F.lit("}")))
        .when(tax == 3, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone")))
        .otherwise(body)
    )
    return df.withColumns(
        {"response": response, "success": F.when(q <= 2, F.lit(None).cast("boolean")).otherwise(q % 10 != 0)}
    ).drop("pred", "target", "n_classes")


# What the text parses to: (class, share) pairs, or nothing.
@view(
    "parsed",
    """
    SELECT * FROM (
      SELECT *, CASE WHEN t <= 3 AND k2 <> k1 THEN [k1, k2] WHEN t <= 3 THEN [k1, k1] WHEN t IN (4, 6) THEN [k1] END AS ks,
             CASE WHEN t <= 3 AND k2 <> k1 THEN [p1 / 100.0::DOUBLE, p2 / 100.0::DOUBLE] WHEN t <= 3 THEN [0.0::DOUBLE, p2 / 100.0::DOUBLE]
                  WHEN t = 4 THEN [m1 / 100.0::DOUBLE]
                  WHEN t = 6 THEN [CAST('0.' || lpad(CAST(m1 AS VARCHAR), 2, '0') AS DOUBLE)] END AS ps
      FROM responses WHERE coalesce(success, true))
    WHERE ks IS NOT NULL
    """,
)
def parsed(t):
    from dissensus.operators import cleaning

    return cleaning.clean(t.responses)


@query(
    "code_fence_answers", "P13",
    """SELECT dataset, split, rid, CASE WHEN regexp_matches(response, '(?s)```json.*?```')
              THEN regexp_extract(response, '(?s)```json(.*?)```', 1) ELSE response END AS response FROM responses""",
)
def _(t):
    return t.responses.select(*KEY, text.json_fence(F.col("response")).alias("response"))


@query(
    "parsed_label_counts", "P14 P5 P6 P53 F1 F2 F4 F5 F6",
    """SELECT dataset, split, rid, k.k AS class_idx, round(coalesce(ps[list_position(ks, k.k)], 0), 6) AS prob,
              abs(list_sum(ps) - 1) < 0.01 AS is_valid_pred
       FROM parsed, range(11) k(k) WHERE k.k < n_classes""",
)
def _(t):
    df = t.parsed.withColumn("__v", F.col("is_valid_pred"))
    out = df.select(*KEY, "is_valid_pred", F.posexplode("pred").alias("class_idx", "prob"))
    return rounded(out)


@query(
    "event_properties", "P14 P15 P48",
    """SELECT event_type, CAST(props ->> 'k' AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL""",
)
def _(t):
    k = text.parse(F.col("props"), "k bigint")["k"]
    return t.events.groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "property_columns", "P48",
    "SELECT event_id, CAST(props ->> 'k' AS VARCHAR) AS k, CAST(NULL AS VARCHAR) AS absent FROM events",
)
def _(t):
    m = t.events.select("event_id", text.parse(F.col("props"), "map<string,string>").alias("metadata"))
    return item_source.flat_metadata(m, ["k", "absent"]).select("event_id", "k", "absent")


@query(
    "label_lists_from_text", "P16 F9",
    """SELECT dataset, split, rid, CASE WHEN t = 8 THEN NULL ELSE CAST([d, t, q] AS VARCHAR) END AS labels FROM answers""",
)
def _(t):
    raw = F.when(F.col("t") == 8, F.lit("[1, two]")).otherwise(
        F.concat(F.lit("["), "d", F.lit(", "), "t", F.lit(".0, "), "q", F.lit("]"))
    )
    ints = text.int_list(raw)
    shown = F.concat(F.lit("["), F.array_join(F.transform(ints, lambda x: x.cast("string")), ", "), F.lit("]"))
    return t.answers.select(*KEY, shown.alias("labels"))


@query(
    "numbers_from_text", "P21 P22 P23 F15",
    """SELECT dataset, split, rid, CASE WHEN t > 4 THEN score END AS score, CAST(trunc(score) AS BIGINT) AS whole, CAST('-123456789' || q || '01' AS BIGINT) AS long_whole,
              CASE WHEN t > 4 THEN CAST(q AS VARCHAR) ELSE 'n' || q END AS label FROM answers""",
)
def _(t):
    raw = F.when(F.col("t") > 4, F.concat(F.lit(" "), F.col("score").cast("string"))).otherwise("none")
    label = F.when(F.col("t") > 4, F.col("q").cast("string")).otherwise(F.concat(F.lit("n"), "q"))
    return t.answers.select(
        *KEY,
        text.number(raw).alias("score"),
        text.whole_number(F.col("score").cast("string")).alias("whole"),
        text.whole_number(F.concat(F.lit("-123456789"), F.col("q").cast("string"), F.lit("01"))).alias("long_whole"),
        text.int_or_text(label).alias("label"),
    )


@query(
    "paragraph_steps", "P39 P41",
    """WITH p AS (SELECT doc_id, string_split(replace(text, '. ', E'.\\n\\n'), E'\\n\\n') AS parts FROM documents),
     x AS (SELECT doc_id, len(parts) AS n_steps, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS idx FROM p)
     SELECT doc_id, n_steps, count(*) FILTER (regexp_matches(part, '\\S')) AS n_filled,
            sum(length(part)) FILTER (regexp_matches(part, '\\S'))::BIGINT AS chars,
            max(idx) FILTER (regexp_matches(part, '\\S'))::INTEGER AS last_idx
     FROM x GROUP BY doc_id, n_steps""",
)
def _(t):
    spaced = F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n"))
    df = t.documents.select("doc_id", spaced.alias("text"))
    steps = df.select(
        "doc_id", text.n_paragraphs(F.col("text")).alias("n_steps"), text.paragraphs(F.col("text")).alias("s")
    )
    size = F.aggregate("s", F.lit(0).cast("bigint"), lambda acc, x: acc + F.char_length(x["text"]))
    filled = F.size("s").cast("bigint")
    return steps.select(
        "doc_id",
        F.col("n_steps").cast("bigint").alias("n_steps"),
        filled.alias("n_filled"),
        F.when(filled > 0, size).alias("chars"),
        F.array_max(F.transform("s", lambda x: x["idx"])).alias("last_idx"),
    )


def learned_sentences_sql(source: str, keys: str) -> str:
    """Tables of a sentence model over the texts of ``source``: ``words``, ``scored_words``,
    ``abbreviations``, ``starters``, and ``ends`` with each token that ends a sentence."""
    blank, closing = r" \t\n\x0B\f\r", "[\"''”’»)\\]]*"
    chance = lambda k, n, q: f"(CASE WHEN {k} > 0 THEN {k} * ln({q}) ELSE 0 END + CASE WHEN {n} - ({k}) > 0 THEN ({n} - ({k})) * ln(1 - {q}) ELSE 0 END)"
    period, number = rf"(^|[^.])\.{closing}$", r"^[\p{N}.,:/-]+$"
    return rf"""tok AS (SELECT {keys}, regexp_extract_all(text, '[^{blank}]+[{blank}]*') AS raws FROM {source}),
     raw AS (SELECT {keys}, unnest(raws) AS raw, generate_subscripts(raws, 1) AS i, len(raws) AS size FROM tok),
     bare AS (SELECT *, regexp_replace(raw, '[{blank}]+$', '') AS t FROM raw),
     stems AS (SELECT *, lower(regexp_replace(t, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')) AS word, regexp_matches(t, '{period}') AS period FROM bare),
     seen AS (SELECT *, lead(t) OVER w AS nt, lead(word) OVER w AS next FROM stems WINDOW w AS (PARTITION BY {keys} ORDER BY i)),
     words AS (SELECT word, count(*) AS n, count(*) FILTER (period) AS k FROM seen WHERE word <> '' GROUP BY word),
     rates AS (SELECT sum(k)::DOUBLE / sum(n) AS p, sum(n)::DOUBLE AS total FROM words),
     lettered AS (SELECT words.*, p, length(replace(word, '.', '')) AS letters FROM words, rates WHERE k > 0),
     scored_words AS (SELECT word, n, k, -2 * ({chance('k', 'n', 'p')} - {chance('k', 'n', '0.99::DOUBLE')}) * exp(-letters) * (length(word) - letters + 1)
                        * pow(letters::DOUBLE, -(n - k)::DOUBLE) AS score FROM lettered WHERE letters > 0 AND NOT regexp_matches(word, '{number}')),
     abbreviations AS (SELECT word FROM scored_words WHERE score >= 0.3),
     follows AS (SELECT next, count(*) AS k FROM seen WHERE word <> '' AND period AND regexp_matches(nt, '^[^\p{{L}}\p{{N}}]*\p{{Lu}}') AND next <> ''
                   AND NOT regexp_matches(word, '^\p{{L}}$') AND NOT regexp_matches(word, '{number}') AND word NOT IN (SELECT word FROM abbreviations) GROUP BY next),
     both_counts AS (SELECT next AS word, f.k, w.n, total, (SELECT sum(k)::DOUBLE FROM follows) AS breaks FROM follows f JOIN words w ON f.next = w.word, rates WHERE w.n >= f.k),
     starters AS (SELECT word FROM both_counts WHERE k / breaks > n / total AND
                    -2 * ({chance('k', 'breaks', '(n / total)')} + {chance('(n - k)', '(total - breaks)', '(n / total)')}
                    - {chance('k', 'breaks', '(k / breaks)')} - {chance('(n - k)', '(total - breaks)', '((n - k) / (total - breaks))')}) >= 30),
     judged AS (SELECT *, regexp_matches(t, '[.!?…]{closing}$') AS marked, regexp_matches(nt, '^[^\p{{L}}\p{{N}}]*\p{{Ll}}') AS lower_next,
                  word IN (SELECT word FROM abbreviations) OR regexp_matches(word, '^\p{{L}}$') AS short, next IN (SELECT word FROM starters) AS starts FROM seen),
     flagged AS (SELECT *, i = size OR (marked AND NOT (period AND ((short AND NOT (starts AND NOT lower_next)) OR (regexp_matches(word, '{number}') AND lower_next)))
                  AND NOT (regexp_matches(t, '(\.\.|…){closing}$') AND lower_next)) AS ends FROM judged),
     numbered AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM flagged),
     cut AS (SELECT {keys}, s, sum(length(raw)) - max(length(raw) - length(t)) FILTER (ends) AS size FROM numbered GROUP BY {keys}, s)"""


@query(
    "sentences_with_learned_abbreviations", "P40",
    f"WITH {learned_sentences_sql('documents', 'doc_id')} SELECT doc_id, count(*) AS n_sentences, max(size)::INTEGER AS longest FROM cut GROUP BY doc_id",
)
def _(t):
    docs = t.documents.select("doc_id", "text")
    found = sentences.split(docs, sentences.train(docs), ["doc_id"])
    return found.select(
        "doc_id",
        F.size("sentences").cast("bigint").alias("n_sentences"),
        F.array_max(F.transform("sentences", F.char_length)).alias("longest"),
    )


@query(
    "abbreviation_scores", "P40",
    f"WITH {learned_sentences_sql('conversations', 'conv_id, turn')} SELECT word, n, k, round(score, 6) AS score FROM scored_words",
)
def _(t):
    return rounded(sentences.abbreviation_scores(sentences.word_counts(t.conversations, "text")))


@query(
    "conversation_sentences", "P40",
    f"WITH {learned_sentences_sql('conversations', 'conv_id, turn')} SELECT conv_id, turn, count(*) AS n_sentences, sum(size)::BIGINT AS chars FROM cut GROUP BY ALL",
)
def _(t):
    rows = t.conversations.select("conv_id", "turn", "text")
    found = sentences.split(rows, sentences.train(rows), ["conv_id", "turn"])
    size = F.aggregate("sentences", F.lit(0).cast("bigint"), lambda acc, x: acc + F.char_length(x))
    return found.select("conv_id", "turn", F.size("sentences").cast("bigint").alias("n_sentences"), size.alias("chars"))


@query(
    "sentence_steps", "P40",
    """WITH s AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '^ +| +$', '', 'g'), '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
     x AS (SELECT doc_id, unnest(parts) AS part FROM s)
     SELECT doc_id, count(*) FILTER (regexp_matches(part, '\\S')) AS n_sentences,
            max(length(part)) FILTER (regexp_matches(part, '\\S'))::INTEGER AS longest FROM x GROUP BY doc_id""",
)
def _(t):
    s = text.sentences(F.col("text"))
    return t.documents.select("doc_id", s.alias("s")).select(
        "doc_id",
        F.size("s").cast("bigint").alias("n_sentences"),
        F.array_max(F.transform("s", lambda x: F.char_length(x["text"]))).alias("longest"),
    )


@query(
    "boxed_answers", "P42",
    """SELECT dataset, split, rid, CASE WHEN t < 8 THEN '\\frac{' || d || '}{' || t || '}' END AS boxed FROM answers""",
)
def _(t):
    raw = F.when(
        F.col("t") < 8, F.concat(F.lit("so \\boxed{\\frac{"), "d", F.lit("}{"), "t", F.lit("}} holds"))
    ).otherwise("no box")
    return t.answers.select(*KEY, text.boxed_answer(raw).alias("boxed"))


@query(
    "batch_service_answers", "P17 P52 S12",
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN role END AS reasoning, text AS response, turn % 3 = 0 AS success
       FROM conversations""",
)
def _(t):
    part = lambda s, thought: F.struct(s.alias("text"), F.lit(thought).alias("thought"))
    answer = part(F.col("text"), None).withField("thought", F.lit(None).cast("boolean"))
    thought = part(F.col("role"), True)
    parts = F.when(F.col("turn") % 2 == 1, F.array(thought, answer)).otherwise(F.array(answer))
    candidate = F.struct(
        F.when(F.col("turn") % 3 == 0, "STOP").otherwise("MAX_TOKENS").alias("finishReason"),
        F.struct(parts.alias("parts")).alias("content"),
    )
    raw = t.conversations.select(
        "conv_id", "turn", F.lit("done").alias("status"), F.lit("x").alias("request"),
        F.struct(F.array(candidate).alias("candidates")).alias("response"),
    )
    return answer_source.from_batch_service(raw)


# --- grades -------------------------------------------------------------------------

# Three step grades per answer as text; one word is not a grade.
@view(
    "judgements",
    """SELECT *, list_transform([d % 4, t % 4, q % 5], lambda i: ['great', 'ok', 'bad', 'okay', 'odd'][i + 1]) AS words,
              CASE WHEN list_contains([d % 4, t % 4, q % 5], 4) THEN NULL
                   ELSE list_transform([d % 4, t % 4, q % 5], lambda i: [1.0, 0.0, 0.0, 0.0][i + 1]::DOUBLE) END AS ok0,
              CASE WHEN list_contains([d % 4, t % 4, q % 5], 4) THEN NULL
                   ELSE list_transform([d % 4, t % 4, q % 5], lambda i: [1.0, 1.0, 0.0, 1.0][i + 1]::DOUBLE) END AS ok1
       FROM labelled""",
)
def judgements(t):
    word = lambda c: F.element_at(F.array(*map(F.lit, ["great", "ok", "bad", "okay", "odd"])), c + 1)
    codes = [F.col("d") % 4, F.col("t") % 4, F.col("q") % 5]
    steps = [
        F.concat(F.lit(f'{{"idx": {i}, "rating": "'), word(c), F.lit('"}')) for i, c in enumerate(codes)
    ]
    text_ = F.concat(F.lit("["), F.concat_ws(", ", *steps), F.lit("]"))
    return t.labelled.drop("score").withColumn("response", text_)


@query(
    "step_scores", "P18 P19 P20",
    """SELECT dataset, split, rid, round(list_avg(ok0), 6) AS mean, list_product(ok0) AS product, list_min(ok0) AS lowest,
              round(list_avg(ok1), 6) AS mean_ok1, list_min(ok1) AS lowest_ok1 FROM judgements""",
)
def _(t):
    parsed_steps = t.judgements.select(*KEY, ratings.parse_ratings(F.col("response")).alias("r"))
    zero = ratings.step_grades(F.col("r"), ratings.GRADE_MAPPINGS["ok=0"])
    one = ratings.step_grades(F.col("r"), ratings.GRADE_MAPPINGS["ok=1"])
    return rounded(
        parsed_steps.select(*KEY, zero.alias("g0"), one.alias("g1")).select(
            *KEY,
            ratings.score(F.col("g0"), "mean").alias("mean"),
            ratings.score(F.col("g0"), "product").alias("product"),
            ratings.score(F.col("g0"), "min").alias("lowest"),
            ratings.score(F.col("g1"), "mean").alias("mean_ok1"),
            ratings.score(F.col("g1"), "min").alias("lowest_ok1"),
        )
    )


@query(
    "ok_sentence_share", "P46",
    "SELECT dataset, split, rid, round(list_avg([(d % 2 = 0)::INT, (t % 2 = 0)::INT, (q % 2 = 0)::INT]), 6) AS reasoning_score FROM answers",
)
def _(t):
    mark = lambda c: F.struct(F.when(F.col(c) % 2 == 0, "1 - ok").otherwise("2 - bad").alias("annotation"))
    marks = F.array(mark("d"), mark("t"), mark("q"))
    return rounded(t.answers.select(*KEY, ratings.ok_share(marks).alias("reasoning_score")))


# --- names, dates, logs -------------------------------------------------------------

@query(
    "model_and_run_names", "P1 P2 P3 P37 P49 J8",
    """SELECT model_id, gen_kwargs, template_id, dataset, n,
              CASE gen_kwargs WHEN 'thinking' THEN 'set1' ELSE gen_kwargs END AS run_set,
              CASE model_id WHEN 'Qwen/Qwen3-32B' THEN 32.0 ELSE 14.0 END::DOUBLE AS model_size,
              CASE model_id WHEN 'Qwen/Qwen3-32B' THEN 'Qwen3-32B' ELSE model_id END AS model_name,
              CASE template_id WHEN 31 THEN '3 +def+pers' ELSE 'incl. steps (soft-label)' END AS template_alias,
              'other' AS domain
       FROM (SELECT model_id, gen_kwargs, template_id, dataset, count(*) AS n FROM answers GROUP BY ALL)""",
)
def _(t):
    c = F.col
    df = t.answers.groupBy("model_id", "gen_kwargs", "template_id", "dataset").agg(F.count(F.lit(1)).alias("n"))
    return df.select(
        "*",
        registry.gen_kwargs_name(c("gen_kwargs")).alias("run_set"),
        registry.model_size(c("model_id")).alias("model_size"),
        registry.model_name(c("model_id")).alias("model_name"),
        registry.template_alias(c("dataset"), c("template_id")).alias("template_alias"),
        registry.domain_name(c("dataset")).alias("domain"),
    )


@query(
    "order_delay_seconds", "P47",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch(l_shipdate - o_orderdate)::DOUBLE AS delay
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def _(t):
    df = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (seconds("l_shipdate") - seconds("o_orderdate")).alias("delay"),
    )


@query(
    "log_lines", "P54",
    """SELECT event_id, strftime(ts, '%m-%d %H:%M:%S') AS stamp, value AS prompt_throughput, floor(value) AS generation_throughput,
              (user_id % 50)::INTEGER AS running_requests, (event_id % 7)::INTEGER AS waiting_requests
       FROM events WHERE event_type <> 'error'""",
)
def _(t):
    return logs.throughput(t.log_text).select(
        "event_id",
        F.date_format("timestamp", "MM-dd HH:mm:ss").alias("stamp"),
        "prompt_throughput",
        "generation_throughput",
        "running_requests",
        "waiting_requests",
    )


@view("log_text", "SELECT * FROM events")
def log_text(t):
    """Events written out as the lines of a throughput log, errors as other lines."""
    line = F.concat(
        F.lit("INFO "), F.date_format("ts", "MM-dd HH:mm:ss"), F.lit(" [loggers.py] Engine 000: Avg prompt throughput: "),
        F.col("value").cast("string"), F.lit(" tokens/s, Avg generation throughput: "),
        F.floor("value").cast("string"), F.lit(" tokens/s, Running: "),
        (F.col("user_id") % 50).cast("string"), F.lit(" reqs, Waiting: "), (F.col("event_id") % 7).cast("string"),
        F.lit(" reqs, GPU KV cache usage: 1.5%, Prefix cache hit rate: 20.0%"),
    )
    return t.events.select(
        "event_id", F.when(F.col("event_type") == "error", "ERROR something").otherwise(line).alias("value")
    )


@query(
    "vector_json_order", "P43",
    """SELECT dataset, split, rid, CAST([t, d, q] AS VARCHAR) AS labels FROM answers""",
)
def _(t):
    from dissensus.sources import submissions

    m = F.create_map(F.lit("entailment"), "d", F.lit("neutral"), "q", F.lit("contradiction"), "t")
    shown = F.concat(
        F.lit("["), F.array_join(submissions.category_order(m).cast("array<string>"), ", "), F.lit("]")
    )
    return t.answers.select(*KEY, shown.alias("labels"))


@query(
    "rating_correlation", "A32",
    """WITH s AS (SELECT corr(d, t) AS dt, corr(d, q) AS dq, corr(t, q) AS tq FROM answers)
       SELECT unnest(['d','d','d','t','t','t','q','q','q']) AS a, unnest(['d','t','q','d','t','q','d','t','q']) AS b,
              unnest([1.0, round(dt, 6), round(dq, 6), round(dt, 6), 1.0, round(tq, 6), round(dq, 6), round(tq, 6), 1.0]::DOUBLE[]) AS corr FROM s""",
)
def _(t):
    return rounded(agreement.correlation_matrix(t.answers, ["d", "t", "q"]))


@query(
    "filled_templates", "B1",
    """SELECT conv_id, turn, '# Task {"role": 1}' || chr(10) || role || ': ' || text || ' (' || turn || ')' AS prompt FROM conversations""",
)
def _(t):
    template = F.lit('# Task {{"role": 1}}\n{role}: {text} ({turn})')
    prompt = prompts.fill(template, {c: F.col(c) for c in ("role", "text", "turn")})
    return t.conversations.select("conv_id", "turn", prompt.alias("prompt"))

"""Streaming reports over whole tables, run until all that is there is processed."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissensus import schemas
from dissensus.session import scratch_folder, written
from dissensus.sources import answers as answer_source
from dissensus.streaming import reports
from workloads.base import query, rounded

ARRIVALS = 4


def events_stream(t):
    schema = t.spark.read.parquet(t.path("events")).schema
    stream = reports.file_stream(t.spark, t.path("events"), schema)
    return stream.withColumn("timestamp", F.col("ts").cast("timestamp"))


@query(
    "streaming_progress", "X1 B10",
    """SELECT event_type, round(avg((value > 20)::INT), 6) AS is_valid_pred, count(*) AS validity_count,
              round(avg(value) FILTER (value > 20), 5) AS avg_ws_loss, count(*) FILTER (value > 20)::BIGINT AS loss_count FROM events GROUP BY ALL""",
)
def _(t):
    rows = events_stream(t).select(
        "event_type", (F.col("value") > 20).alias("is_valid_pred"), F.col("value").alias("ws_loss")
    )
    report = reports.progress(rows, ["event_type"])
    out = reports.run_to_table(report, "progress", mode="update", keys=["event_type"])
    return out.select(
        "event_type", F.round("is_valid_pred", 6).alias("is_valid_pred"), "validity_count",
        F.round("avg_ws_loss", 5).alias("avg_ws_loss"), "loss_count",
    )


@query(
    "streaming_distinct", "X2",
    "SELECT user_id, event_type, count(*) > 0 AS seen FROM events GROUP BY ALL",
)
def _(t):
    rows = events_stream(t).select("user_id", "event_type", "timestamp")
    kept = reports.distinct_answers(rows, ["user_id", "event_type"], delay="60 days")
    out = reports.run_to_table(kept, "distinct")
    return out.groupBy("user_id", "event_type").agg((F.count(F.lit(1)) == 1).alias("seen"))


@query(
    "streaming_throughput", "X3 P54",
    """SELECT time_bucket(INTERVAL '6 hours', ts) AS start, round(avg(value), 5) AS avg_value, max(value) AS max_value, count(*) AS n
     FROM events GROUP BY ALL""",
)
def _(t):
    report = reports.throughput_windows(
        events_stream(t).select("timestamp", "value"), [], "value", width="6 hours"
    )
    # Windows that are still open are in the result as well.
    out = rounded(reports.run_to_table(report, "throughput", mode="update", keys=["start"]), 5)
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "streaming_active_periods", "X3",
    """WITH g AS (SELECT event_type, ts, value, CASE WHEN ts > lag(ts) OVER w + INTERVAL '15 minutes' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
     s AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
     p AS (SELECT event_type, min(ts) AS start, max(ts) + INTERVAL '15 minutes' AS "end", count(*) AS n, round(avg(value), 5) AS avg_value FROM s GROUP BY event_type, sid)
     SELECT * FROM p""",
)
def _(t):
    rows = events_stream(t).select("event_type", "timestamp", "value")
    report = reports.active_periods(rows, ["event_type"], "value", gap="15 minutes")
    out = rounded(reports.run_to_table(report, "periods", mode="complete"), 5)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


# --- lines that keep arriving -------------------------------------------------------

ARRIVED = f"""SELECT e.*, ((epoch_us(ts) - lo) * {ARRIVALS}) // (hi - lo + 1) AS arrival
     FROM events e, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)"""


def arrived_events(t):
    """Events with the part of their time span they fall in: each part arrives as new files."""
    rows = t.events.withColumn("timestamp", F.col("ts").cast("timestamp"))
    micros = F.unix_micros("timestamp")
    span = rows.agg(F.min(micros).alias("lo"), F.max(micros).alias("hi")).first()
    lo, hi = (span["lo"], span["hi"]) if span["lo"] is not None else (0, 0)
    # Whole numbers: a decimal quotient would be rounded up at the end of the span.
    part = F.expr(f"int((unix_micros(timestamp) - {lo}) * {ARRIVALS} div {hi - lo + 1})")
    return rows.withColumn("arrival", part)


@query(
    "streaming_appended_lines", "X1 S8 B10",
    f"""WITH e AS ({ARRIVED})
     SELECT a.a::INTEGER AS arrival, event_type AS model_id, round(avg((value > 20)::INT), 6) AS is_valid_pred, count(*) AS validity_count,
            round(avg(value) FILTER (value > 20), 5) AS avg_ws_loss, count(*) FILTER (value > 20)::BIGINT AS loss_count
     FROM range({ARRIVALS}) a(a) JOIN e ON e.arrival <= a.a GROUP BY ALL""",
)
def _(t):
    """The report after every arrival of JSON lines; each run starts from the last one's state."""
    folder = scratch_folder(t.spark, "lines")
    events = arrived_events(t)
    seen = []
    for arrival in range(ARRIVALS):
        answers = events.where(F.col("arrival") == arrival).select(
            F.col("event_id").alias("dataset_idx"), F.lit(0).alias("run_idx"), F.col("event_type").alias("model_id"),
            F.col("value").cast("string").alias("response"), (F.col("value") > 20).alias("success"),
        )
        answer_source.append_answers(answers, f"{folder}/in/run")
        stream = reports.answer_stream(t.spark, f"{folder}/in", schemas.PREDICTIONS, max_files=3)
        rows = stream.select("model_id", "success", F.col("response").cast("double").alias("loss"))
        report = reports.progress(rows, ["model_id"], "success", "loss")
        table = reports.run_to_table(report, "lines", "update", ["model_id"], f"{folder}/out")
        # The next run adds to the folder this table is read from.
        seen.append(written(table, "report").select(F.lit(arrival).alias("arrival"), "*"))
    every = functools.reduce(DataFrame.unionByName, seen)
    return every.withColumns(
        {"is_valid_pred": F.round("is_valid_pred", 6), "avg_ws_loss": F.round("avg_ws_loss", 5)}
    )


@query(
    "streaming_late_and_repeated", "X2",
    f"""WITH e AS ({ARRIVED}),
     m AS (SELECT a.a AS arrival, date_trunc('milliseconds', max(ts)) - INTERVAL 2 DAY AS mark
           FROM range({ARRIVALS}) a(a) JOIN e ON e.arrival <= a.a AND e.event_type <> 'error' GROUP BY ALL)
     SELECT event_id, user_id, event_type, ts AS timestamp FROM e LEFT JOIN m USING (arrival)
     WHERE event_type <> 'error' OR mark IS NULL OR ts > mark""",
)
def _(t):
    """Answers kept once, over arrivals with a restart between them.

    Errors arrive one part late: those still within the delay count, older ones are
    behind the watermark. All other rows of a part are sent again with the next one.
    """
    folder = scratch_folder(t.spark, "repeated")
    events = arrived_events(t)
    late = F.col("event_type") == "error"
    table = None
    for arrival in range(ARRIVALS + 1):
        now = (F.col("arrival") == arrival) & ~late
        before = F.col("arrival") == arrival - 1
        rows = events.where(now | before).select("event_id", "user_id", "event_type", F.unix_micros("timestamp").alias("at"))
        rows.write.mode("append").json(f"{folder}/in/run")
        stream = reports.answer_stream(t.spark, f"{folder}/in", "event_id bigint, user_id bigint, event_type string, at bigint")
        stream = stream.withColumn("timestamp", F.timestamp_micros("at")).drop("at")
        kept = reports.distinct_answers(stream, ["event_id"], delay="2 days")
        table = reports.run_to_table(kept, "repeated", folder=f"{folder}/out")
    return table.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))

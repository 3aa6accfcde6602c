"""Every operator as a query over the test tables, with the SQL it must equal.

``events`` stands in for the login log: ``error`` is the failure, ``purchase``
the reset, every other type leaves the counter alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallywatch.operators import (
    balance as balancing,
    clean,
    difference,
    documents as json_texts,
    encode,
    grouping,
    labels,
    metrics,
    model,
    quantiles,
    reports,
    scale,
    select,
    series,
    sketches,
    temporal,
)
from tallywatch.operators.pieces import Cut, ticks
from tallywatch.operators.sequence import (
    SequenceRule,
    consecutive_failures,
    rule_hits,
    user_state,
)
from tallywatch.plans.pipeline import FittedPipeline, PipelineRun, PipelineSpec, run_pipeline
from tallywatch.session import scratch_path, stage
from tallywatch.sources import tables
from tallywatch.streaming import login_stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

LOGINS = SequenceRule(
    key="user_id", order="event_id", event="event_type", fail="error", reset="purchase"
)
LONG_RUN = replace(LOGINS, name="Long Login Failure Run", threshold=5)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        name = run.__name__.removesuffix("_")
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return register


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return tables.scan_table(spark, f"{folder}/{table}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "events").select("event_id", "user_id", "event_type", "value")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# ---------------------------------------------------------------- the rule

# The rule as a running counter, which is how it is stated.
LABELED_SQL = """
runs AS (
    SELECT event_id, user_id, event_type, value,
           SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)
               OVER (PARTITION BY user_id ORDER BY event_id) AS run
    FROM events),
counters AS (
    SELECT *, SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id, run ORDER BY event_id) AS counter
    FROM runs),
labeled AS (
    SELECT event_id, user_id, event_type, value, counter,
           CAST(CASE WHEN event_type = 'error' AND counter >= 3 THEN 1 ELSE 0 END AS INTEGER)
               AS label
    FROM counters)
"""

CONSECUTIVE_SQL = f"WITH {LABELED_SQL} SELECT event_id, user_id, event_type, label FROM labeled"


@query(CONSECUTIVE_SQL)
def consecutive_failures_(spark, folder):
    logins = load(spark, folder, "events").select("event_id", "user_id", "event_type")
    return consecutive_failures(logins, LOGINS)


@query(CONSECUTIVE_SQL)
def consecutive_failures_segmented(spark, folder):
    """The rule with every user cut into pieces, as a busy user's log would be."""
    rule = replace(LOGINS, task_rows=10, piece_rows=5000)
    logins = load(spark, folder, "events").select("event_id", "user_id", "event_type")
    return consecutive_failures(logins, rule)


# The stream's watermark after all rows, in whole milliseconds.
WATERMARK_SQL = "(SELECT epoch_us(MAX(ts)) // 1000 * 1000 - 3600000000 FROM events WHERE event_type IN ({}))"


def streamed(spark: SparkSession, folder: str, make: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The whole table read as a stream, until nothing is left, and what was appended."""
    schema = load(spark, folder, "events").schema
    # A pattern, since a stream's path must be a folder otherwise.
    source = spark.readStream.schema(schema).parquet(f"{folder}/events.parquet*")
    target = scratch_path(spark, name)
    result = make(source)
    login_stream.write_stream(result, target, {"availableNow": True}).awaitTermination()
    return spark.read.schema(result.schema).parquet(target + "/output")


@query(CONSECUTIVE_SQL)
def consecutive_failures_stream(spark, folder):
    """Every event with the label that the rule on a stream gives it, to the stream's end.

    The table is one micro-batch. A reset at the end of time comes with it, so the watermark
    passes all events after it, and they are judged in their order.
    """
    log = load(spark, folder, "events")
    # Within what pandas can hold. Order is by id: an event without a time waits for the end.
    kind = log.schema["ts"].dataType
    first, undated, end = (F.lit(t).cast(kind) for t in ("1970-01-02 00:00:00", "2262-01-01 00:00:00", "2262-01-02 00:00:00"))
    last = {"event_id": F.lit(2**63 - 1), "event_type": F.lit(LOGINS.reset), "ts": end}
    path = scratch_path(spark, "stream-end")
    row = [last.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in log.schema]
    spark.range(1).select(*row).write.parquet(path)

    def flagged(source):
        timed = source.withColumn("ts", F.least(F.greatest(F.coalesce("ts", undated), first), undated))
        closed = timed.unionByName(spark.readStream.schema(log.schema).parquet(path))
        return login_stream.flagged_failures(closed, LOGINS, "ts", timedelta(hours=1))

    hits = streamed(spark, folder, flagged, "rule-stream").select("user", "id").distinct()
    logins = log.select("event_id", "user_id", "event_type")
    failed = LOGINS.failed()
    met = (F.col("event_id") == F.col("id")) & F.col("user_id").eqNullSafe(F.col("user"))
    label = F.col("id").isNotNull().cast("int").alias("label")
    judged = logins.filter(failed).join(hits, met, "left").select(*logins.columns, label)
    return logins.filter(~failed).select("*", F.lit(0).alias("label")).unionByName(judged)


@query(
    f"""
    WITH failed AS (
        SELECT user_id, epoch_us(ts) // 21600000000 * 21600000000 AS started FROM events
        WHERE event_type = 'error')
    SELECT user_id, started, COUNT(*) AS failures FROM failed
    WHERE started + 21600000000 <= {WATERMARK_SQL.format("'error'")} GROUP BY user_id, started
    """
)
def failure_windows_stream(spark, folder):
    """Failures per user and quarter of a day, as far as the watermark closes them."""

    def windows(source):
        return login_stream.failure_windows(source, LOGINS, "ts", timedelta(hours=6), timedelta(hours=1))

    found = in_micros(streamed(spark, folder, windows, "window-stream"), "started")
    return found.select(F.col("user").alias("user_id"), "started", "failures")


USER_STATE_SQL = """
WITH last_reset AS (
    SELECT user_id, MAX(CASE WHEN event_type = 'purchase' THEN event_id END) AS at
    FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id)
SELECT e.user_id AS "user",
       CAST(SUM(CASE WHEN e.event_type = 'error' AND (l.at IS NULL OR e.event_id > l.at)
                     THEN 1 ELSE 0 END) AS BIGINT) AS failures
FROM events e JOIN last_reset l ON e.user_id = l.user_id
WHERE e.event_type IN ('error', 'purchase') GROUP BY e.user_id
"""


@query(USER_STATE_SQL)
def user_state_(spark, folder):
    return user_state(events(spark, folder), LOGINS)


@query(
    """
    SELECT ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) AS id, *,
           CAST(0 AS INTEGER) AS label
    FROM orders
    """
)
def create_labeled(spark, folder):
    return labels.create_labeled(load(spark, folder, "orders"), "o_orderdate", "o_orderkey")


@query(
    """
    SELECT ROW_NUMBER() OVER (ORDER BY ts, event_id) AS id, *, CAST(0 AS INTEGER) AS label
    FROM (SELECT event_id, TIMESTAMP '2024-01-01' + TO_MICROSECONDS(event_id * 7 % 1000003) AS ts,
                 user_id, event_type, value, props
          FROM events)
    """
)
def create_labeled_burst(spark, folder):
    """Numbering of a log whose events all fall within two seconds."""
    burst = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("event_id") * 7 % 1000003)
    log = load(spark, folder, "events").withColumn("ts", burst.cast("timestamp_ntz"))
    return labels.create_labeled(log, "ts", "event_id")


@query(
    f"""
    WITH {LABELED_SQL}
    SELECT event_id, user_id,
           CAST(CASE WHEN event_type = 'signup' THEN 1 ELSE label END AS INTEGER) AS label
    FROM labeled
    """
)
def update_label(spark, folder):
    """Labels set earlier (here: on signups) stay, the rule's come on top."""
    log = events(spark, folder)
    earlier = log.withColumn("label", (F.col("event_type") == "signup").cast("int"))
    hits = rule_hits(log, [LOGINS]).withColumnRenamed("id", "event_id")
    return labels.update_label(earlier, hits, "event_id").select("event_id", "user_id", "label")


@query(
    f"""
    WITH {LABELED_SQL}
    SELECT CAST(COUNT(*) AS BIGINT) AS events,
           CAST(COUNT(DISTINCT CASE WHEN event_type IN ('error', 'purchase') THEN user_id END)
               AS BIGINT) AS users,
           CAST(SUM(label) AS BIGINT) AS anomalies
    FROM labeled
    """
)
def kpi_summary(spark, folder):
    return reports.kpi_summary(consecutive_failures(events(spark, folder), LOGINS), LOGINS)


@query(
    f"""
    WITH {LABELED_SQL}
    SELECT user_id AS "user", CAST(COUNT(*) AS BIGINT) AS anomalies
    FROM labeled WHERE label = 1 GROUP BY user_id
    ORDER BY anomalies DESC, user_id LIMIT 10
    """
)
def top_users(spark, folder):
    return reports.top_users(rule_hits(events(spark, folder), [LOGINS]))


@query(
    f"""
    WITH {LABELED_SQL},
    hits AS (
        SELECT 'Anomalous Login Failure Attempted' AS rule
        FROM labeled WHERE event_type = 'error' AND counter >= 3
        UNION ALL
        SELECT 'Long Login Failure Run' FROM labeled WHERE event_type = 'error' AND counter >= 5)
    SELECT rule, CAST(COUNT(*) AS BIGINT) AS anomalies FROM hits GROUP BY rule
    """
)
def rule_counts(spark, folder):
    return reports.rule_counts(rule_hits(events(spark, folder), [LOGINS, LONG_RUN]))


@query("SELECT DISTINCT user_id FROM events")
def distinct_users(spark, folder):
    return reports.distinct_users(events(spark, folder), "user_id")


@query(
    f"""
    WITH {LABELED_SQL}
    SELECT event_id, user_id, event_type, label, label = 1 AS is_flagged
    FROM labeled ORDER BY event_id LIMIT 10
    """
)
def preview(spark, folder):
    labeled = consecutive_failures(
        events(spark, folder).select("event_id", "user_id", "event_type"), LOGINS
    )
    return reports.preview(labeled, "event_id", 10)


# ------------------------------------------------------ sources and sinks


@query("SELECT * FROM documents")
def csv_round_trip(spark, folder):
    """Texts with line breaks, quotes and outer blanks come back as they were."""
    documents = load(spark, folder, "documents")
    path = scratch_path(spark, "csv")
    tables.write_csv(documents, path)
    return tables.scan_csv(spark, path, documents.schema)


@query(
    """
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_returnflag = 'R' AND l_quantity > 25
    """
)
def scan_table(spark, folder):
    lines = load(spark, folder, "lineitem")
    return lines.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25)).select(
        "l_orderkey", "l_linenumber", "l_quantity"
    )


# -------------------------------------------------- cleaning and profiling


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def normalize_names(spark, folder):
    customers = load(spark, folder, "customer")
    dotted = customers.toDF(*[n.replace("_", ".") for n in customers.columns])
    return clean.normalize_names(dotted)


@query("SELECT *, ' ' AS space FROM customer")
def drop_empty_columns(spark, folder):
    customers = load(spark, folder, "customer").select(
        "*",
        F.nullif("c_custkey", "c_custkey").alias("nothing"),
        F.when(F.col("c_acctbal") < 0, "").alias("blank"),
        F.lit(" ").alias("space"),
    )
    return clean.drop_empty_columns(customers)


def _holes(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with nulls put in."""
    open_order = F.col("o_orderstatus") == "O"
    return load(spark, folder, "orders").select(
        "o_orderkey",
        F.when(~open_order, F.col("o_custkey")).alias("o_custkey"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("o_totalprice"),
        F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"),
        "o_orderpriority",
    )


HOLES_SQL = """
holes AS (
    SELECT o_orderkey,
           CASE WHEN o_orderstatus <> 'O' THEN o_custkey END AS o_custkey,
           CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS o_totalprice,
           NULLIF(o_orderstatus, 'F') AS o_orderstatus,
           o_orderpriority
    FROM orders)
"""
HOLE_COLUMNS = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")


@query(
    f"WITH {HOLES_SQL}"
    + " UNION ALL ".join(
        f"""
        SELECT '{n}' AS "column", CAST(COUNT(*) - COUNT({n}) AS BIGINT) AS nulls,
               COUNT(*) > COUNT({n}) AS has_nulls FROM holes
        """
        for n in HOLE_COLUMNS
    )
)
def null_profile(spark, folder):
    return clean.null_profile(_holes(spark, folder))


@query(
    f"""
    WITH {HOLES_SQL}
    SELECT o_orderkey, COALESCE(o_custkey, 0) AS o_custkey,
           COALESCE(o_totalprice, 0.0) AS o_totalprice,
           COALESCE(o_orderstatus, 'unknown') AS o_orderstatus, o_orderpriority
    FROM holes
    """
)
def fill_nulls(spark, folder):
    return clean.fill_nulls(_holes(spark, folder), strings="unknown")


@query(
    """
    WITH q AS (
        SELECT quantile_disc(value, 0.25) AS q1, quantile_disc(value, 0.75) AS q3 FROM events)
    SELECT event_id, value FROM events, q
    WHERE value >= q1 - 2 * (q3 - q1) AND value <= q3 + 2 * (q3 - q1)
    """
)
def drop_outliers(spark, folder):
    log = load(spark, folder, "events").select("event_id", "value")
    return clean.drop_outliers(log, ["value"], error=0)


@query(
    """
    WITH d AS (
        SELECT doc_id, n_chars, CAST(n_chars AS DOUBLE) * n_chars AS area FROM documents),
    q AS (
        SELECT quantile_disc(n_chars, 0.25) AS q1, quantile_disc(n_chars, 0.75) AS q3 FROM d),
    first_cut AS (
        SELECT d.* FROM d, q
        WHERE n_chars >= q1 - 2.0 * (q3 - q1) AND n_chars <= q3 + 2.0 * (q3 - q1)),
    q2 AS (
        SELECT quantile_disc(area, 0.25) AS q1, quantile_disc(area, 0.75) AS q3 FROM first_cut)
    SELECT doc_id, n_chars, area FROM first_cut, q2
    WHERE area >= q1 - 2.0 * (q3 - q1) AND area <= q3 + 2.0 * (q3 - q1)
    """
)
def drop_outliers_sequential(spark, folder):
    sizes = load(spark, folder, "documents").select(
        "doc_id", "n_chars", (F.col("n_chars").cast("double") * F.col("n_chars")).alias("area")
    )
    return clean.drop_outliers_sequential(sizes, ["n_chars", "area"], error=0)


LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
#: Every number of the table.
ALL_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINE_NUMBERS)


@query(
    " UNION ALL ".join(
        f"""
        SELECT '{n}' AS "column", CAST(COUNT({n}) AS BIGINT) AS "count",
               ROUND(AVG({n}), 4) AS mean, ROUND(STDDEV_SAMP({n}), 4) AS stddev,
               MIN({n}) AS "min", MAX({n}) AS "max" FROM lineitem
        """
        for n in ALL_NUMBERS
    )
)
def describe(spark, folder):
    return rounded(reports.describe(load(spark, folder, "lineitem")), 4, "mean", "stddev")


@query(
    " UNION ALL ".join(
        f"""
        SELECT '{n}' AS "column", CAST(COUNT({n}) AS BIGINT) AS "count",
               MIN({n}) AS "min", MAX({n}) AS "max" FROM customer
        """
        for n in ("c_name", "c_mktsegment")
    )
)
def describe_text(spark, folder):
    return reports.describe_text(load(spark, folder, "customer"))


PROBABILITIES = (0.01, 0.25, 0.5, 0.75, 0.99)


@query(
    " UNION ALL ".join(
        f"""
        SELECT '{n}' AS "column", CAST({p} AS DOUBLE) AS probability,
               CAST(quantile_disc({n}, {p}) AS DOUBLE) AS value FROM lineitem
        """
        for n in ALL_NUMBERS
        for p in PROBABILITIES
    )
)
def quantiles_(spark, folder):
    return quantiles.quantile_table(load(spark, folder, "lineitem"), ALL_NUMBERS, PROBABILITIES, error=0)


@query(
    " UNION ALL ".join(
        f"""
        SELECT '{n}' AS "column", CAST({p} AS DOUBLE) AS probability, TRUE AS near
        """
        for n in ALL_NUMBERS
        for p in PROBABILITIES
    )
)
def quantiles_default_error(spark, folder):
    """The default sketch: the rows up to each value are within 0.05 of all rows."""
    lines = load(spark, folder, "lineitem")
    found = quantiles.approx_quantiles(lines, ALL_NUMBERS, PROBABILITIES, 0.05)
    checks = [
        F.struct(
            F.lit(n).alias("column"),
            F.lit(p).alias("probability"),
            # A value's rows end at or after the place sought, and start at or before it.
            (
                (F.count_if(F.col(n) <= v) >= (p - 0.05) * F.count(n))
                & (F.count_if(F.col(n) < v) <= (p + 0.05) * F.count(n))
            ).alias("near"),
        )
        for n in ALL_NUMBERS
        for p, v in zip(PROBABILITIES, found[n])
    ]
    return lines.agg(F.array(*checks).alias("checks")).select(F.inline("checks"))


@query(
    """
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'
    """
)
def filter_eq(spark, folder):
    orders = load(spark, folder, "orders")
    return reports.filter_eq(orders, o_orderstatus="F", o_orderpriority="5-LOW").select(
        "o_orderkey", "o_totalprice"
    )


# --------------------------------------------------------------- reports


@query("SELECT event_type, CAST(COUNT(*) AS BIGINT) AS \"count\" FROM events GROUP BY event_type")
def class_distribution(spark, folder):
    return reports.class_distribution(events(spark, folder), "event_type")


@query(
    f"""
    WITH {LABELED_SQL}
    SELECT event_type, label, CAST(COUNT(*) AS BIGINT) AS "count"
    FROM labeled GROUP BY event_type, label
    """
)
def class_by_dimension(spark, folder):
    labeled = consecutive_failures(events(spark, folder), LOGINS)
    return reports.class_by_dimension(labeled, "event_type", "label")


@query('SELECT CAST(COUNT(*) AS BIGINT) AS "rows", CAST(11 AS INTEGER) AS "columns" FROM lineitem')
def shape(spark, folder):
    return reports.shape(load(spark, folder, "lineitem"))


# --------------------------------------------- scored rows and evaluation

# A score any engine can compute: the event's value, rescaled.
SCORES_SQL = """
scores AS (
    SELECT event_id, user_id, value / 100.0 AS prediction,
           CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INTEGER) AS label
    FROM events)
"""


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select(
        "event_id",
        "user_id",
        (F.col("value") / 100.0).alias("prediction"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


@query(
    f"""
    WITH {SCORES_SQL}
    SELECT event_id, label,
           CAST(CASE WHEN prediction >= 0.8 THEN 1 ELSE 0 END AS INTEGER) AS prediction
    FROM scores
    """
)
def threshold_prediction(spark, folder):
    return metrics.threshold_prediction(_scores(spark, folder)).select(
        "event_id", "label", "prediction"
    )


@query(
    f"""
    WITH {SCORES_SQL}
    SELECT CAST(SUM(CASE WHEN prediction < 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS normal,
           CAST(SUM(CASE WHEN prediction >= 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS anomaly
    FROM scores
    """
)
def prediction_counts(spark, folder):
    return reports.prediction_counts(metrics.threshold_prediction(_scores(spark, folder)))


@query(f'WITH {SCORES_SQL} SELECT event_id, user_id, label, prediction AS "Threat" FROM scores')
def shape_scores(spark, folder):
    scored = _scores(spark, folder).withColumns(
        {n: F.array("prediction") for n in model.MODEL_COLUMNS}
    )
    return model.shape_scores(scored)


@query(
    f"""
    WITH {SCORES_SQL},
    m AS (SELECT AVG(label) AS mean_label, VAR_POP(label) AS spread FROM scores)
    SELECT ROUND(SQRT(AVG(POWER(label - prediction, 2))), 6) AS rmse,
           ROUND(AVG(POWER(label - prediction, 2)), 6) AS mse,
           ROUND(1 - AVG(POWER(label - prediction, 2)) / MAX(spread), 6) AS r2,
           ROUND(AVG(POWER(prediction - mean_label, 2)), 6) AS var,
           ROUND(AVG(ABS(label - prediction)), 6) AS mae
    FROM scores, m
    """
)
def regression_metrics(spark, folder):
    found = metrics.regression_metrics(_scores(spark, folder))
    return rounded(found, 6, *found.columns)


@query(
    f"""
    WITH {SCORES_SQL},
    points AS (
        SELECT prediction, SUM(label) AS pos, SUM(1 - label) AS neg
        FROM scores GROUP BY prediction),
    curve AS (
        SELECT *, SUM(pos) OVER (ORDER BY prediction DESC) AS tp,
               SUM(neg) OVER (ORDER BY prediction DESC) AS fp
        FROM points),
    steps AS (
        SELECT *, tp / (tp + fp) AS prec,
               LAG(tp / (tp + fp)) OVER (ORDER BY prediction DESC) AS prec_before
        FROM curve)
    SELECT ROUND(CAST(SUM(neg * (tp - pos / 2)) AS DOUBLE) / (SUM(pos) * SUM(neg)), 6)
               AS "areaUnderROC",
           ROUND(SUM(pos * (prec + COALESCE(prec_before, prec)) / 2) / SUM(pos), 6)
               AS "areaUnderPR"
    FROM steps
    """
)
def binary_metrics(spark, folder):
    found = metrics.binary_metrics(_scores(spark, folder))
    return rounded(found, 6, *found.columns)


@query(
    f"""
    WITH {SCORES_SQL},
    hard AS (
        SELECT label, CASE WHEN prediction >= 0.8 THEN 1 ELSE 0 END AS p FROM scores),
    m AS (
        SELECT CAST(COUNT(*) AS DOUBLE) AS n,
               CAST(SUM(CASE WHEN label = 0 AND p = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS t0,
               CAST(SUM(CASE WHEN label = 1 AND p = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS t1,
               CAST(SUM(CASE WHEN label = 1 AND p = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS f0,
               CAST(SUM(CASE WHEN label = 0 AND p = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS f1
        FROM hard),
    r AS (
        SELECT *, t0 / (t0 + f0) AS p0, t1 / (t1 + f1) AS p1,
               t0 / (t0 + f1) AS r0, t1 / (t1 + f0) AS r1, t0 + f1 AS n0, t1 + f0 AS n1
        FROM m)
    SELECT ROUND((n0 * 2 * p0 * r0 / (p0 + r0) + n1 * 2 * p1 * r1 / (p1 + r1)) / n, 6) AS f1,
           ROUND((n0 * p0 + n1 * p1) / n, 6) AS "weightedPrecision",
           ROUND((n0 * r0 + n1 * r1) / n, 6) AS "weightedRecall",
           ROUND((t0 + t1) / n, 6) AS accuracy,
           ROUND(f0 / n1, 6) AS "falsePositiveRateByLabel",
           ROUND(p0, 6) AS "precisionByLabel",
           ROUND(r0, 6) AS "recallByLabel"
    FROM r
    """
)
def multiclass_metrics(spark, folder):
    found = metrics.multiclass_metrics(metrics.threshold_prediction(_scores(spark, folder)))
    return rounded(found, 6, *found.columns)


# ------------------------------------------------- balancing and splitting


@query(
    """
    WITH sized AS (SELECT CAST(FLOOR(SUM(toxic) * 1.3) AS BIGINT) AS quota FROM labels),
    placed AS (
        SELECT doc_id, quality, toxic,
               ROW_NUMBER() OVER (
                   PARTITION BY toxic ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS place
        FROM labels)
    SELECT doc_id, quality, toxic FROM placed, sized WHERE toxic = 1 OR place <= quota
    """
)
def balance(spark, folder):
    return balancing.balance(load(spark, folder, "labels"), "toxic", "doc_id", 1.3)


@query(
    """
    SELECT event_id, event_type,
           CASE WHEN CAST('0x' || SUBSTR(md5(CAST(event_id AS VARCHAR)), 1, 6) AS INTEGER) % 10 < 8
                THEN 'train' ELSE 'test' END AS part
    FROM events
    """
)
def train_test_split(spark, folder):
    log = events(spark, folder).select("event_id", "event_type")
    train, test = balancing.train_test_split(log, "event_id")
    return train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))


# ---------------------------------------------------------------- encoders

# Murmur3 over little-endian words: the mixing of one word, then of the state.
MIX_WORDS_SQL = """
list_transform(list_transform(list_transform({words},
    lambda w: (w * 3432918353::UBIGINT) % 4294967296::UBIGINT),
    lambda w: (w * 32768::UBIGINT) % 4294967296::UBIGINT + w // 131072::UBIGINT),
    lambda w: (w * 461845907::UBIGINT) % 4294967296::UBIGINT)
"""
MIX_STATE_SQL = """
list_reduce(list_prepend(42::UBIGINT, {words}), lambda h, w:
    (((xor(h, w) * 8192::UBIGINT) % 4294967296::UBIGINT + xor(h, w) // 524288::UBIGINT)
     * 5::UBIGINT + 3864292196::UBIGINT) % 4294967296::UBIGINT)
"""
BYTES_SQL = """
list_transform(range(0, CAST(octet_length(encode(v)) AS BIGINT)),
    lambda i: CAST('0x' || SUBSTR(HEX(encode(v)), CAST(2 * i + 1 AS BIGINT), 2) AS UBIGINT))
"""
WORDS_SQL = """
list_transform(range(0, CAST(len(b) // 4 AS BIGINT)), lambda i:
    b[4 * i + 1] + b[4 * i + 2] * 256::UBIGINT + b[4 * i + 3] * 65536::UBIGINT
    + b[4 * i + 4] * 16777216::UBIGINT)
"""
# The last steps of Murmur3, from the state ``h`` and the length ``n``.
FINISH_SQL = """
s1 AS (SELECT v, xor(h, n) AS h FROM s0),
s2 AS (SELECT v, (xor(h, h // 65536::UBIGINT) * 2246822507::UBIGINT) % 4294967296::UBIGINT AS h
       FROM s1),
s3 AS (SELECT v, (xor(h, h // 8192::UBIGINT) * 3266489909::UBIGINT) % 4294967296::UBIGINT AS h
       FROM s2),
hashed AS (SELECT v, CAST(xor(h, h // 65536::UBIGINT) AS BIGINT) AS h FROM s3)
"""


@query(
    f"""
    WITH vals AS (
        SELECT DISTINCT o_orderpriority AS v FROM orders
        UNION SELECT DISTINCT o_orderstatus FROM orders),
    bytes AS (SELECT v, {BYTES_SQL} AS b FROM vals),
    -- left-over bytes are mixed in one by one, as signed numbers
    words AS (
        SELECT v, CAST(len(b) AS UBIGINT) AS n,
               list_concat({WORDS_SQL}, list_transform(
                   list_slice(b, CAST(len(b) // 4 * 4 + 1 AS BIGINT), CAST(len(b) AS BIGINT)),
                   lambda x: CASE WHEN x >= 128 THEN x + 4294967040::UBIGINT ELSE x END)) AS w
        FROM bytes),
    mixed AS (SELECT v, n, {MIX_WORDS_SQL.format(words="w")} AS w FROM words),
    s0 AS (SELECT v, n, {MIX_STATE_SQL.format(words="w")} AS h FROM mixed),
    {FINISH_SQL},
    codes AS (
        SELECT v, CAST(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS INTEGER) AS code
        FROM hashed)
    SELECT o.o_orderkey, p.code AS o_orderpriority, s.code AS o_orderstatus
    FROM orders o JOIN codes p ON o.o_orderpriority = p.v JOIN codes s ON o.o_orderstatus = s.v
    """
)
def hash_encode(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return encode.hash_encode(orders)


def _index_sql(table: str, column: str) -> str:
    return f"""
        SELECT {column} AS value,
               CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {column}) - 1 AS DOUBLE) AS idx
        FROM {table} GROUP BY {column}
    """


@query(
    f"""
    WITH priority AS ({_index_sql("orders", "o_orderpriority")}),
    status AS ({_index_sql("orders", "o_orderstatus")})
    SELECT o.o_orderkey, p.idx AS o_orderpriority, s.idx AS o_orderstatus
    FROM orders o JOIN priority p ON o.o_orderpriority = p.value
                  JOIN status s ON o.o_orderstatus = s.value
    """
)
def label_encode(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return encode.label_encode(orders)


WIDE = ("o_orderstatus", "o_orderpriority", "bill", "due", "buyer", "c_name", "c_mktsegment")
WIDE_SQL = """
wide AS (
    SELECT o_orderkey, o_orderstatus, o_orderpriority, 'bill ' || o_orderkey AS bill,
           CASE WHEN o_orderkey % 7 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS due,
           'buyer ' || o_custkey AS buyer, c_name, c_mktsegment
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
"""


@query(
    f"WITH {WIDE_SQL}, "
    + ", ".join(f"index_{n} AS ({_index_sql('wide', n)} HAVING {n} IS NOT NULL)" for n in WIDE)
    + " SELECT o_orderkey, "
    + ", ".join(
        f"COALESCE(index_{n}.idx, (SELECT CAST(COUNT(*) AS DOUBLE) FROM index_{n})) AS {n}" for n in WIDE
    )
    + " FROM wide "
    + " ".join(f"LEFT JOIN index_{n} ON wide.{n} = index_{n}.value" for n in WIDE)
)
def label_encode_wide(spark, folder):
    """Seven text columns, four of them with more values than a broadcast takes at any size."""
    customers = load(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    orders = load(spark, folder, "orders")
    wide = orders.join(customers, orders.o_custkey == customers.c_custkey, "left").select(
        "o_orderkey",
        "o_orderstatus",
        "o_orderpriority",
        F.concat(F.lit("bill "), F.col("o_orderkey").cast("string")).alias("bill"),
        F.when(F.col("o_orderkey") % 7 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("due"),
        F.concat(F.lit("buyer "), F.col("o_custkey").cast("string")).alias("buyer"),
        "c_name",
        "c_mktsegment",
    )
    return encode.label_encode(wide)


# Words of a text: no trailing empty words, and none at all in a blank text.
WORDS_OF_SQL = r"""
    SELECT doc_id, CASE WHEN text <> '' AND regexp_replace(text, '\s+$', '') = '' THEN []
        ELSE regexp_split_to_array(regexp_replace(lower(text), '\s+$', ''), '\s') END AS words
    FROM documents
"""


@query(
    f"""
    WITH split AS ({WORDS_OF_SQL})
    SELECT doc_id, CAST(len(words) AS INTEGER) AS n_words, array_to_string(words, '|') AS words
    FROM split
    """
)
def tokenize(spark, folder):
    documents = load(spark, folder, "documents").select("doc_id", "text")
    return encode.tokenize(documents, "text", "words").select(
        "doc_id", F.size("words").alias("n_words"), F.array_join("words", "|").alias("words")
    )


@query(
    f"""
    WITH split AS ({WORDS_OF_SQL}),
    counted AS (
        SELECT doc_id, w AS v, COUNT(*) AS n
        FROM (SELECT doc_id, UNNEST(words) AS w FROM split) GROUP BY doc_id, w),
    vals AS (SELECT DISTINCT v FROM counted),
    bytes AS (SELECT v, {BYTES_SQL} AS b FROM vals),
    words AS (
        SELECT v, CAST(len(b) AS UBIGINT) AS n, {WORDS_SQL} AS w,
               list_slice(b, CAST(len(b) // 4 * 4 + 1 AS BIGINT), CAST(len(b) AS BIGINT)) AS rest
        FROM bytes),
    -- left-over bytes make one short last word
    tails AS (
        SELECT v, n, w, [COALESCE(rest[1], 0) + COALESCE(rest[2], 0) * 256::UBIGINT
                         + COALESCE(rest[3], 0) * 65536::UBIGINT] AS t FROM words),
    mixed AS (
        SELECT v, n, {MIX_WORDS_SQL.format(words="w")} AS w, {MIX_WORDS_SQL.format(words="t")} AS t
        FROM tails),
    s0 AS (SELECT v, n, xor({MIX_STATE_SQL.format(words="w")}, t[1]) AS h FROM mixed),
    {FINISH_SQL}
    SELECT doc_id, CAST(h % 262144 AS INTEGER) AS slot, CAST(SUM(n) AS DOUBLE) AS tf
    FROM counted JOIN hashed ON counted.v = hashed.v GROUP BY doc_id, slot
    """
)
def hashing_tf(spark, folder):
    documents = load(spark, folder, "documents").select("doc_id", "text")
    vector = F.unwrap_udt("text")
    entries = F.arrays_zip(
        vector["indices"].alias("slot"), vector["values"].alias("tf")
    )
    return encode.hashing_tf(documents).select("doc_id", F.inline(entries))


# ---------------------------------------------- vectors, scaling, selection


def _parts(df: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """The key and the vector's entries as columns."""
    arrays = df.select(key, vector_to_array("features").alias("entries"))
    return arrays.select(key, *[F.col("entries")[i].alias(n) for i, n in enumerate(names)])


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line numbers with a constant column, assembled."""
    lines = load(spark, folder, "lineitem").select(
        "l_orderkey", *LINE_NUMBERS, F.lit(1.0).alias("one")
    )
    return encode.assemble(lines, exclude=("l_orderkey",))


SCALED = (*LINE_NUMBERS, "one")


def _scaled(df: DataFrame) -> DataFrame:
    return rounded(_parts(df, "l_orderkey", SCALED), 6, *SCALED)


@query(
    """
    SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS f0, l_quantity AS f1,
           l_extendedprice AS f2, l_discount AS f3, l_tax AS f4
    FROM lineitem
    """
)
def assemble(spark, folder):
    lines = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *LINE_NUMBERS)
    names = tuple(f"f{i}" for i in range(5))
    return _parts(encode.assemble(lines, exclude=("l_orderkey",)), "l_orderkey", names)


BUCKET_SQL = """
    CAST(CASE WHEN {x} < -0.5 THEN 0 WHEN {x} < 0 THEN 1 WHEN {x} < 0.5 THEN 2 ELSE 3 END AS DOUBLE)
"""


@query(
    f"""
    SELECT l_orderkey, {BUCKET_SQL.format(x="(l_discount * 20 - 1)")} AS discount,
           {BUCKET_SQL.format(x="(l_quantity / 25 - 1)")} AS quantity
    FROM lineitem
    """
)
def bucketize(spark, folder):
    lines = load(spark, folder, "lineitem").select(
        "l_orderkey",
        (F.col("l_discount") * 20 - 1).alias("discount"),
        (F.col("l_quantity") / 25 - 1).alias("quantity"),
    )
    return scale.bucketize(lines, ["discount", "quantity"])


@query(
    """
    WITH parts AS (
        SELECT vec_id, UNNEST(range(0, len(embedding))) AS i,
               CAST(UNNEST(embedding) AS DOUBLE) AS x
        FROM embeddings)
    SELECT vec_id, CAST(i AS INTEGER) AS i,
           ROUND(x / SUM(ABS(x)) OVER (PARTITION BY vec_id), 6) AS x
    FROM parts
    """
)
def l1_normalize(spark, folder):
    vectors = load(spark, folder, "embeddings").select(
        "vec_id", array_to_vector("embedding").alias("features")
    )
    entries = scale.l1_normalize(vectors).select(
        "vec_id", F.posexplode(vector_to_array("features")).alias("i", "x")
    )
    return rounded(entries, 6, "x")


def _scale_sql(term: str, of_constant: float, stats: str) -> str:
    terms = ", ".join(f"ROUND({term.format(x=n)}, 6) AS {n}" for n in LINE_NUMBERS)
    found = ", ".join(stats.format(x=n) for n in LINE_NUMBERS)
    return f"""
        WITH s AS (SELECT {found} FROM lineitem)
        SELECT l_orderkey, {terms}, CAST({of_constant} AS DOUBLE) AS one FROM lineitem, s
    """


@query(_scale_sql("{x} / {x}_max", 1, "MAX(ABS({x})) AS {x}_max"))
def max_abs_scale(spark, folder):
    return _scaled(scale.max_abs_scale(_lines(spark, folder)))


@query(
    _scale_sql(
        "({x} - {x}_min) / ({x}_max - {x}_min)", 0.5, "MIN({x}) AS {x}_min, MAX({x}) AS {x}_max"
    )
)
def min_max_scale(spark, folder):
    return _scaled(scale.min_max_scale(_lines(spark, folder)))


@query(
    _scale_sql(
        "({x} - {x}_mean) / {x}_dev", 0, "AVG({x}) AS {x}_mean, STDDEV_SAMP({x}) AS {x}_dev"
    )
)
def standard_scale(spark, folder):
    return _scaled(scale.standard_scale(_lines(spark, folder)))


@query(
    _scale_sql(
        "{x} / ({x}_q3 - {x}_q1)",
        0,
        "quantile_disc({x}, 0.25) AS {x}_q1, quantile_disc({x}, 0.75) AS {x}_q3",
    )
)
def robust_scale(spark, folder):
    return _scaled(scale.robust_scale(_lines(spark, folder), exact_from=SCALED))


CATEGORIES = ("l_linenumber", "l_quantity", "l_discount", "l_tax", "status", "size", "month", "day")
CHI_SQL = """
categories AS (
    SELECT l_orderkey,
           CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label,
           CAST(l_linenumber AS DOUBLE) AS l_linenumber, l_quantity, l_discount, l_tax,
           CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS status,
           FLOOR(l_extendedprice / 10000) AS size,
           CAST(MONTH(l_shipdate) AS DOUBLE) AS month, CAST(DAY(l_shipdate) AS DOUBLE) AS day
    FROM lineitem),
pairs AS (
""" + " UNION ALL ".join(
    f"SELECT label, '{n}' AS feature, CAST({n} AS DOUBLE) AS value FROM categories"
    for n in CATEGORIES
) + """),
cells AS (
    SELECT feature, value, label, COUNT(*) AS n FROM pairs GROUP BY feature, value, label),
expected AS (
    SELECT *, SUM(n) OVER (PARTITION BY feature, value) AS n_value,
           SUM(n) OVER (PARTITION BY feature, label) AS n_label,
           SUM(n) OVER (PARTITION BY feature) AS total
    FROM cells),
tests AS (
    SELECT feature,
           (SUM(n * n / (CAST(n_value AS DOUBLE) * n_label)) - 1) * MAX(total) AS statistic,
           (COUNT(DISTINCT value) - 1) * (COUNT(DISTINCT label) - 1) AS dof
    FROM expected GROUP BY feature)
"""


def _categories(spark: SparkSession, folder: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return load(spark, folder, "lineitem").select(
        "l_orderkey",
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("label"),
        F.col("l_linenumber").cast("double").alias("l_linenumber"),
        "l_quantity",
        "l_discount",
        "l_tax",
        (F.col("l_linestatus") == "O").cast("double").alias("status"),
        F.floor(F.col("l_extendedprice") / 10000).cast("double").alias("size"),
        F.month("l_shipdate").cast("double").alias("month"),
        F.day("l_shipdate").cast("double").alias("day"),
    )


@query(
    f"""
    WITH {CHI_SQL}
    SELECT feature, ROUND(statistic, 5) AS statistic, CAST(dof AS BIGINT) AS dof FROM tests
    """
)
def chi_square_table(spark, folder):
    found = select.chi_square_table(_categories(spark, folder), CATEGORIES)
    return rounded(found, 5, "statistic")


# The p-value's order, through the Wilson-Hilferty normal score of each test.
@query(
    f"""
    WITH {CHI_SQL},
    best AS (
        SELECT feature FROM tests
        ORDER BY (POWER(statistic / dof, 1.0 / 3) - (1 - 2 / (9.0 * dof))) / SQRT(2 / (9.0 * dof))
            DESC LIMIT 5),
    rated AS (SELECT {", ".join(
        f"(SELECT COUNT(*) FROM best WHERE feature = '{n}') AS keep_{n}" for n in CATEGORIES
    )})
    SELECT l_orderkey, list_aggregate(list_transform(list_filter([{", ".join(
        f"CASE WHEN keep_{n} = 1 THEN {n} END" for n in CATEGORIES
    )}], lambda x: x IS NOT NULL), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)),
        'string_agg', ',') AS selected
    FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount * 100 AS l_discount,
                 l_tax * 100 AS l_tax, status, size, month, day FROM categories), rated
    """
)
def chi_square_select(spark, folder):
    """The kept features of every line as text, fractions in hundredths."""
    kept = select.chi_square_select(
        encode.assemble(
            _categories(spark, folder).withColumns(
                {n: F.round(F.col(n) * 100) for n in ("l_discount", "l_tax")}
            ),
            exclude=("l_orderkey", "label"),
        )
    )
    numbers = F.transform(
        vector_to_array("selectedFeatures"), lambda x: x.cast("bigint").cast("string")
    )
    return kept.select("l_orderkey", F.array_join(numbers, ",").alias("selected"))


# ---------------------------------------------------------------- models


def _training(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged events with two plain features."""
    labeled = consecutive_failures(events(spark, folder), LOGINS)
    plain = labeled.select(
        "event_id",
        (F.col("event_type") == "error").cast("int").alias("failed"),
        "value",
        "label",
    )
    return encode.assemble(plain, exclude=("event_id", "label"))


# Ridge regression on two features in closed form: the correlation matrix with
# the penalty (in units of the label's deviation) on its diagonal.
RIDGE_SQL = f"""
WITH {LABELED_SQL},
rows_in AS (
    SELECT event_id, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END::DOUBLE AS a, value AS b,
           CAST(label AS DOUBLE) AS y, label
    FROM labeled),
s AS (
    SELECT AVG(a) AS ma, AVG(b) AS mb, AVG(y) AS my, STDDEV_POP(a) AS sa, STDDEV_POP(b) AS sb,
           STDDEV_POP(y) AS sy, CORR(a, y) AS ray, CORR(b, y) AS rby, CORR(a, b) AS rab
    FROM rows_in),
d AS (SELECT *, 1 + 0.01 / sy AS diag FROM s),
w AS (
    SELECT *, (ray * diag - rby * rab) / (diag * diag - rab * rab) * sy / sa AS wa,
           (rby * diag - ray * rab) / (diag * diag - rab * rab) * sy / sb AS wb
    FROM d),
scored AS (
    SELECT event_id, label, my + wa * (a - ma) + wb * (b - mb) AS score FROM rows_in, w)
SELECT event_id, label, ROUND(score, 6) AS score,
       CAST(CASE WHEN score >= 0.2 THEN 1 ELSE 0 END AS INTEGER) AS prediction
FROM scored
"""


@query(RIDGE_SQL)
def fit_linear(spark, folder):
    rows = _training(spark, folder)
    fitted = model.fit(rows, model.linear())
    scored = fitted.transform(rows).withColumn("score", F.round("prediction", 6))
    return metrics.threshold_prediction(scored, 0.2).select(
        "event_id", "label", "score", "prediction"
    )


# Three kinds of events with a label rate each: the fitted model of two indicator features
# has as many weights as there are kinds, so its probabilities are the rates.
RATES_SQL = """
kinds AS (
    SELECT event_id,
           CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS kind,
           CAST(CASE WHEN value > CASE event_type WHEN 'error' THEN 20 WHEN 'click' THEN 60
                                  ELSE 100 END THEN 1 ELSE 0 END AS INTEGER) AS label
    FROM events)
"""


def _kinds(spark: SparkSession, folder: str) -> DataFrame:
    failed, clicked = (F.col("event_type") == t for t in ("error", "click"))
    limit = F.when(failed, 20).when(clicked, 60).otherwise(100)
    rows = events(spark, folder).select(
        "event_id",
        failed.cast("int").alias("failed"),
        clicked.cast("int").alias("clicked"),
        (F.col("value") > limit).cast("int").alias("label"),
    )
    return encode.assemble(rows, exclude=("event_id", "label"))


@query(
    f"""
    WITH {RATES_SQL}
    SELECT event_id, label, ROUND(AVG(label) OVER (PARTITION BY kind), 3) AS score,
           CASE WHEN AVG(label) OVER (PARTITION BY kind) > 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE
               AS prediction
    FROM kinds
    """
)
def fit_logistic(spark, folder):
    scored = model.fit_logistic(_kinds(spark, folder))
    return scored.select(
        "event_id",
        "label",
        F.round(vector_to_array("probability")[1], 3).alias("score"),
        "prediction",
    )


@query(
    f"""
    WITH {RATES_SQL},
    points AS (
        SELECT kind, CAST(SUM(label) AS DOUBLE) AS pos, CAST(SUM(1 - label) AS DOUBLE) AS neg
        FROM kinds
        WHERE CAST('0x' || SUBSTR(md5(CAST(event_id AS VARCHAR)), 1, 6) AS INTEGER) % 10 >= 8
        GROUP BY kind),
    curve AS (
        SELECT *, SUM(pos) OVER (ORDER BY kind DESC) AS tp, SUM(neg) OVER (ORDER BY kind DESC) AS fp
        FROM points),
    steps AS (
        SELECT *, tp / (tp + fp) AS prec,
               LAG(tp / (tp + fp)) OVER (ORDER BY kind DESC) AS prec_before
        FROM curve)
    SELECT ROUND(SUM(neg * (tp - pos / 2)) / (SUM(pos) * SUM(neg)), 6) AS "areaUnderROC",
           ROUND(SUM(pos * (prec + COALESCE(prec_before, prec)) / 2) / SUM(pos), 6)
               AS "areaUnderPR"
    FROM steps
    """
)
def model_evaluation(spark, folder):
    """Trained on eight tenths, evaluated on the raw scores of the others."""
    train, test = balancing.train_test_split(_kinds(spark, folder), "event_id")
    scored = model.fit(train, model.logistic()).transform(test)
    return rounded(
        metrics.binary_metrics(scored, score="rawPrediction"), 6, "areaUnderROC", "areaUnderPR"
    )


@query(
    f"""
    WITH {LABELED_SQL}
    SELECT event_type = 'error' AS failed, CAST(COUNT(*) AS BIGINT) AS n,
           ROUND(AVG(label), 3) AS expected
    FROM labeled GROUP BY event_type = 'error'
    """
)
def logistic_calibration(spark, folder):
    """At the optimum the mean probability equals the label rate on both sides of
    an indicator feature."""
    scored = model.fit_logistic(_training(spark, folder))
    return scored.groupBy((F.col("failed") == 1).alias("failed")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.mean(vector_to_array("probability")[1]), 3).alias("expected"),
    )


# A label that one feature decides, beside one that says nothing: any model must find it.
DECIDED_SQL = """
SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS label,
       CAST(event_type = 'error' AS INTEGER)::DOUBLE AS prediction
FROM events
"""


def _decided(spark: SparkSession, folder: str) -> DataFrame:
    failed = (F.col("event_type") == "error").cast("int")
    rows = events(spark, folder).filter("event_type is not null").select(
        "event_id", failed.alias("failed"), F.coalesce("value", F.lit(0.0)).alias("value"), failed.alias("label")
    )
    return encode.assemble(rows, exclude=("event_id", "label"))


def _undecided(spark: SparkSession, folder: str) -> DataFrame:
    """Events without a type have no label, and no model says one."""
    return events(spark, folder).filter("event_type is null").select(
        "event_id", F.lit(None).cast("int").alias("label"), F.lit(None).cast("double").alias("prediction")
    )


@query(DECIDED_SQL)
def fit_forest(spark, folder):
    scored = model.fit_forest(_decided(spark, folder)).select("event_id", "label", "prediction")
    return scored.unionByName(_undecided(spark, folder))


@query(DECIDED_SQL)
def fit_svm(spark, folder):
    """Trained on balanced rows, since failures are few, and applied to all."""
    rows = stage(_decided(spark, folder), "decided")
    even = balancing.balance(rows, "label", "event_id", 1.0)
    scored = model.fit(even, model.svm()).transform(rows)
    return scored.select("event_id", "label", "prediction").unionByName(_undecided(spark, folder))


@query(
    """
    SELECT CAST(event_type = 'error' AS INTEGER)::DOUBLE AS "Threat",
           CAST(COUNT(*) AS BIGINT) AS "count", CAST(0 AS BIGINT) AS mismatches
    FROM events GROUP BY 1
    """
)
def model_round_trip(spark, folder):
    """Train a forest, store it, load it, score, count per threat; the stored model must
    say what the fitted one does."""
    rows = stage(_decided(spark, folder), "decided")
    path = scratch_path(spark, "forest")
    fitted = model.fit(rows, model.forest())
    model.save_model(fitted, path)
    both = model.load_and_score(path, fitted.transform(rows).select("event_id", "features",
                                F.col("prediction").alias("fitted")))
    differ = F.sum((F.col("Threat") != F.col("fitted")).cast("bigint")).alias("mismatches")
    none = _undecided(spark, folder).groupBy(F.col("prediction").alias("Threat")).agg(
        F.count(F.lit(1)).alias("count"), F.lit(0).cast("bigint").alias("mismatches")
    )
    return both.groupBy("Threat").agg(F.count(F.lit(1)).alias("count"), differ).unionByName(none)


# -------------------------------------------------------------- whole jobs


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "events").withColumnRenamed("event_id", "id")


def _spec(**options) -> PipelineSpec:
    return PipelineSpec(rule=replace(LOGINS, order="id"), **options)


# Every event is scored and counted; the digest of its key decides who is held out.
JOB_SQL = """
SELECT CAST(COUNT(*) AS BIGINT) AS "rows", CAST(COUNT(*) AS BIGINT) AS scored,
       CAST(COUNT(*) AS BIGINT) AS counted,
       CAST(COUNT(CASE WHEN CAST('0x' || SUBSTR(md5(CAST(event_id AS VARCHAR)), 1, 6) AS INTEGER)
                            % 10 >= 8 THEN 1 END) AS BIGINT) AS held_out
FROM events
"""


def _sizes(log: DataFrame, run: PipelineRun) -> DataFrame:
    """One row: events in, scored, counted as normal or anomaly, and held out."""
    counts = run.counts().select((F.col("normal") + F.col("anomaly")).alias("counted"))
    sizes = [
        df.agg(F.count(F.lit(1)).alias(name))
        for name, df in (("rows", log), ("scored", run.scores), ("held_out", run.held_out))
    ]
    # Four tables of one row each.
    return sizes[0].join(sizes[1]).join(counts).join(sizes[2])


@query(JOB_SQL)
def run_pipeline_(spark, folder):
    """Hash encoding, standard scaling, feature selection, logistic regression."""
    spec = _spec(
        cleaning=("Clean_data", "Handle_null_values", "Remove_outliers"),
        scaling="Standered_scaler",
        selection="Chisqselector",
        model="Logistic_regression",
    )
    log = _log(spark, folder)
    return _sizes(log, run_pipeline(log, spec))


@query(
    """
    SELECT CAST(COUNT(*) AS BIGINT) AS "rows", CAST(0 AS BIGINT) AS mismatches FROM events
    """
)
def run_pipeline_forest(spark, folder):
    """Label encoding, balanced training rows, a forest; stored, loaded, and applied to the
    log as it comes: the stored job must say what the fitted one does."""
    spec = _spec(
        cleaning=("Clean_data", "Balance_data"),
        formatting="Lebel_encoding",
        scaling="Minmax_scaler",
        model="Random_forest",
    )
    log = _log(spark, folder)
    run = run_pipeline(log, spec)
    path = scratch_path(spark, "pipeline")
    run.fitted.save(path)
    again = FittedPipeline.load(spark, path).transform(log)
    fitted = run.scores.select("id", F.col("prediction").alias("fitted"))
    both = model.shape_scores(again).select("id", "Threat").join(fitted, "id")
    return both.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum((F.col("Threat") != F.col("fitted")).cast("bigint")), F.lit(0)).alias(
            "mismatches"
        ),
    )


@query(JOB_SQL)
def run_pipeline_robust(spark, folder):
    """Robust scaling and a support vector machine."""
    spec = _spec(cleaning=("Balance_data",), scaling="Robust_scaler", model="Linear_SVM")
    log = _log(spark, folder)
    return _sizes(log, run_pipeline(log, spec))


@query(JOB_SQL)
def run_pipeline_linear(spark, folder):
    """Word counts, scaling by the largest value, linear regression."""
    spec = _spec(
        formatting="HashingTF_Encoding", text_slots=64, scaling="MinAbs_scaler",
        model="Linear_regression",
    )
    log = _log(spark, folder)
    return _sizes(log, run_pipeline(log, spec))


# Jobs on a label that one column decides: every model must find it, so SQL knows all values.
DECIDED = {
    "Random_forest": {
        "cleaning": ("Clean_data", "Handle_null_values"), "formatting": "Lebel_encoding", "scaling": "Minmax_scaler",
    },
    "Logistic_regression": {
        "cleaning": ("Clean_data", "Balance_data"), "scaling": "Standered_scaler", "selection": "Chisqselector",
    },
    "Linear_SVM": {"cleaning": ("Handle_null_values",), "scaling": "MinAbs_scaler"},
    "Linear_regression": {"formatting": "HashingTF_Encoding", "text_slots": 16, "scaling": "MinAbs_scaler"},
}
DECIDED_LOG_SQL = """
decided AS (
    SELECT event_id AS id, CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INTEGER) AS label
    FROM events)
"""


def _decided_log(spark: SparkSession, folder: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    return load(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        "ts",
        "event_type",
        "value",
        F.when(failed, 10.0).otherwise(0.0).alias("signal"),
        failed.cast("int").alias("label"),
    )


def _decided_run(spark: SparkSession, folder: str, name: str) -> PipelineRun:
    return run_pipeline(_decided_log(spark, folder), PipelineSpec(name, rule=None, **DECIDED[name]))


@query(
    f"""
    WITH {DECIDED_LOG_SQL}
    SELECT model, id, label, label AS prediction
    FROM decided, (VALUES {", ".join(f"('{name}')" for name in DECIDED)}) AS m(model)
    """
)
def run_pipeline_decided(spark, folder):
    """The prediction for every row, of whole jobs with each of the four models."""
    found = [
        _decided_run(spark, folder, name).scores.select(
            F.lit(name).alias("model"), "id", "label", F.col("prediction").cast("int").alias("prediction")
        )
        for name in DECIDED
    ]
    return reduce(DataFrame.unionByName, found)


@query(
    f"""
    WITH {DECIDED_LOG_SQL},
    held AS (
        SELECT CAST(label AS DOUBLE) AS y FROM decided
        WHERE CAST('0x' || SUBSTR(md5(CAST(id AS VARCHAR)), 1, 6) AS INTEGER) % 10 >= 8)
    SELECT model, metric, CASE WHEN metric = 'var' THEN (SELECT ROUND(VAR_POP(y), 6) FROM held) ELSE value END AS value
    FROM (VALUES ('areaUnderROC', 1.0::DOUBLE), ('areaUnderPR', 1.0), ('accuracy', 1.0), ('f1', 1.0),
                 ('weightedPrecision', 1.0), ('weightedRecall', 1.0), ('falsePositiveRateByLabel', 0.0),
                 ('rmse', 0.0), ('mse', 0.0), ('mae', 0.0), ('r2', 1.0), ('var', 0.0)) AS v(metric, value),
         (VALUES ('Logistic_regression'), ('Linear_regression')) AS m(model)
    """
)
def run_pipeline_metrics(spark, folder):
    """A job's own evaluation on its held-out rows: curves, classes, errors."""
    rows = []
    for name in ("Logistic_regression", "Linear_regression"):
        run = _decided_run(spark, folder, name)
        for part in (run.binary(), run.multiclass(), run.regression()):
            wanted = [n for n in part.columns if n not in ("precisionByLabel", "recallByLabel")]
            values = [F.struct(F.lit(n).alias("metric"), F.round(n, 6).alias("value")) for n in wanted]
            rows.append(part.select(F.lit(name).alias("model"), F.inline(F.array(*values))))
    return reduce(DataFrame.unionByName, rows)


@query(f"WITH {DECIDED_LOG_SQL} SELECT id, CASE WHEN label = 1 THEN 'anomaly' ELSE 'normal' END AS class FROM decided")
def csv_job(spark, folder):
    """Train on a CSV file with a text label, store the job, load it, score a CSV file without one."""
    path = scratch_path(spark, "csv-job")
    class_ = F.when(F.col("label") == 1, "anomaly").otherwise("normal").alias("class")
    rows = _decided_log(spark, folder).select("id", "event_type", "value", "signal", class_)
    tables.write_csv(rows, f"{path}/train")
    tables.write_csv(rows.drop("class"), f"{path}/test")
    train, test = tables.read_data(spark, f"{path}/train", f"{path}/test")
    spec = PipelineSpec("Random_forest", rule=None, label="class", formatting="Lebel_encoding", scaling="Minmax_scaler")
    run_pipeline(train, spec).fitted.save(f"{path}/job")
    scored = FittedPipeline.load(spark, f"{path}/job").transform(test)
    # The commoner class is 0.
    return scored.select("id", F.when(F.col("prediction") == 0, "normal").otherwise("anomaly").alias("class"))


# ---------------------------------------------------------------- along time

#: Cuts every user into pieces, as a busy user's log would be.
SMALL_CUT = Cut(task_rows=10, piece_rows=5000)


def failures(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "events").filter("event_type = 'error'")


def in_micros(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: ticks(df, n) for n in names})


ASOF_SQL = """
SELECT f.event_id, f.user_id, l.event_id AS logon_id, l.value AS logon_value,
       epoch_us(f.ts) - epoch_us(l.ts) AS micros_since
FROM (SELECT * FROM events WHERE event_type = 'error') f
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') l
    ON f.user_id = l.user_id AND f.ts >= l.ts
"""


def last_logon(spark: SparkSession, folder: str, cut: Cut) -> DataFrame:
    logons = load(spark, folder, "events").filter("event_type = 'purchase'")
    take = {"event_id": "logon_id", "value": "logon_value", "ts": "logon_ts"}
    found = temporal.asof_join(
        failures(spark, folder), logons, ["user_id"], "ts", take, tie="event_id", cut=cut
    )
    return in_micros(found, "ts", "logon_ts").select(
        "event_id", "user_id", "logon_id", "logon_value", (F.col("ts") - F.col("logon_ts")).alias("micros_since")
    )


@query(ASOF_SQL)
def asof_join(spark, folder):
    """Per failure the last logon before it."""
    return last_logon(spark, folder, Cut())


@query(ASOF_SQL)
def asof_join_segmented(spark, folder):
    return last_logon(spark, folder, SMALL_CUT)


def sessions_sql(where: str, hours: int) -> str:
    """Sessions as they are stated: a row after a long pause begins one."""
    return f"""
    (SELECT user_id, MIN(ts) AS started, MAX(ts) AS ended, COUNT(*) AS events,
            CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failures
     FROM (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS number
           FROM (SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts)
                                     <= INTERVAL {hours} HOUR THEN 0 ELSE 1 END AS fresh
                 FROM events WHERE {where}))
     GROUP BY user_id, number)
    """


SESSIONS_SQL = f"""
SELECT user_id, epoch_us(started) AS started, epoch_us(ended) AS ended, events, failures,
       epoch_us(ended) - epoch_us(started) AS micros
FROM {sessions_sql("TRUE", 6)}
"""


def user_sessions(spark: SparkSession, folder: str, cut: Cut) -> DataFrame:
    failed = F.when(F.col("event_type") == "error", 1).otherwise(0)
    found = temporal.sessions(
        load(spark, folder, "events"), ["user_id"], "ts", timedelta(hours=6), {"failures": failed}, cut
    )
    return in_micros(found, "started", "ended").withColumn("micros", F.col("ended") - F.col("started"))


@query(SESSIONS_SQL)
def sessions_by_gap(spark, folder):
    """Bursts of a user's events, with their failures and duration."""
    return user_sessions(spark, folder, Cut())


@query(SESSIONS_SQL)
def sessions_by_gap_segmented(spark, folder):
    return user_sessions(spark, folder, SMALL_CUT)


def bursts(spark: SparkSession, folder: str, hours: int) -> DataFrame:
    found = temporal.sessions(failures(spark, folder), ["user_id"], "ts", timedelta(hours=hours))
    return found.filter("events > 1")


@query(
    f"""
    WITH bursts AS (SELECT * FROM {sessions_sql("event_type = 'error'", 2)} WHERE events > 1)
    SELECT e.event_id, e.user_id, b.user_id AS burst_user, epoch_us(b.started) AS burst_started,
           b.events AS burst_events
    FROM events e JOIN bursts b
        ON e.ts BETWEEN b.started AND b.ended AND e.user_id <> b.user_id
    """
)
def interval_join(spark, folder):
    """Events that fall into other users' bursts of failures."""
    take = {"user_id": "burst_user", "started": "burst_started", "events": "burst_events"}
    others = in_micros(bursts(spark, folder, 2), "started", "ended")
    met = temporal.interval_join(load(spark, folder, "events"), others, ("ts", "ts"), ("started", "ended"), take)
    return met.filter("user_id <> burst_user").select("event_id", "user_id", *take.values())


@query(
    f"""
    WITH bursts AS (SELECT * FROM {sessions_sql("event_type = 'error'", 6)} WHERE events > 1)
    SELECT a.user_id, epoch_us(a.started) AS started, b.user_id AS other_user,
           epoch_us(b.started) AS other_started,
           LEAST(epoch_us(a.ended), epoch_us(b.ended)) - GREATEST(epoch_us(a.started), epoch_us(b.started))
               AS micros
    FROM bursts a JOIN bursts b ON a.started <= b.ended AND b.started <= a.ended AND a.user_id < b.user_id
    """
)
def interval_join_segmented(spark, folder):
    """Bursts of two users at one time, with full buckets dealt to several tasks."""
    own = stage(in_micros(bursts(spark, folder, 6), "started", "ended"), "bursts")
    take = {"user_id": "other_user", "started": "other_started", "ended": "other_ended"}
    ends = ("started", "ended")
    met = temporal.interval_join(own, own, ends, ends, take, task_rows=3).filter("user_id < other_user")
    shared = F.least("ended", "other_ended") - F.greatest("started", "other_started")
    return met.select("user_id", "started", "other_user", "other_started", shared.alias("micros"))


RANGE_FRAME_SQL = """
SELECT event_id, user_id, event_type,
       CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER day AS BIGINT) AS failures,
       CAST(SUM(CAST(round(value * 100) AS BIGINT)) OVER day AS BIGINT) AS cents,
       MIN(value) OVER day AS lowest, MAX(value) OVER day AS highest
FROM events
WINDOW day AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)
"""


def last_day(spark: SparkSession, folder: str, cut: Cut) -> DataFrame:
    values = {
        "failures": ("count", F.when(F.col("event_type") == "error", 1)),
        "cents": ("sum", F.round(F.col("value") * 100).cast("bigint")),
        "lowest": ("min", F.col("value")),
        "highest": ("max", F.col("value")),
    }
    found = temporal.range_frame(
        load(spark, folder, "events"), ["user_id"], "ts", timedelta(days=1), values, cut=cut
    )
    return found.select("event_id", "user_id", "event_type", *values)


@query(RANGE_FRAME_SQL)
def range_frame(spark, folder):
    """Failures and amounts of the user's last day, at each event."""
    return last_day(spark, folder, Cut())


@query(RANGE_FRAME_SQL)
def range_frame_segmented(spark, folder):
    return last_day(spark, folder, SMALL_CUT)


# ---------------------------------------------------------------- subtotals

DIMENSIONS = ["event_type", "user_class", "day"]
#: One user in ten has no class, which is a group and no subtotal.
CLASSED_SQL = """
(SELECT *, CASE WHEN user_id % 10 > 0 THEN 'class ' || (user_id % 3) END AS user_class,
        strftime(ts, '%Y-%m-%d') AS day FROM events)
"""


def subtotal_sql(sets: str) -> str:
    return f"""
    SELECT event_type, user_class, day, GROUPING(event_type, user_class, day) AS level, COUNT(*) AS events,
           CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, MAX(value) AS highest
    FROM {CLASSED_SQL} GROUP BY {sets}
    """


def subtotals() -> dict[str, tuple[str, Column]]:
    return {
        "events": ("count", F.lit(1)),
        "cents": ("sum", F.round(F.col("value") * 100).cast("bigint")),
        "highest": ("max", F.col("value")),
    }


def classed(spark: SparkSession, folder: str) -> DataFrame:
    user = F.col("user_id")
    return load(spark, folder, "events").withColumns(
        {
            "user_class": F.when(user % 10 > 0, F.concat(F.lit("class "), (user % 3).cast("string"))),
            "day": F.date_format("ts", "yyyy-MM-dd"),
        }
    )


@query(subtotal_sql("GROUPING SETS ((event_type, user_class), (event_type, day), (day), ())"))
def grouping_sets(spark, folder):
    sets = [["event_type", "user_class"], ["event_type", "day"], ["day"], []]
    return grouping.grouping_sets(classed(spark, folder), sets, subtotals())


@query(subtotal_sql("ROLLUP (event_type, user_class, day)"))
def rollup(spark, folder):
    return grouping.rollup(classed(spark, folder), DIMENSIONS, subtotals())


@query(subtotal_sql("CUBE (event_type, user_class, day)"))
def cube(spark, folder):
    return grouping.cube(classed(spark, folder), DIMENSIONS, subtotals())


# ---------------------------------------------------------------- summaries that merge


@query(
    """
    SELECT CAST(d.day AS VARCHAR) AS day, TRUE AS near, COUNT(*) AS events
    FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) d
    JOIN events e ON CAST(e.ts AS DATE) BETWEEN d.day - 6 AND d.day
    GROUP BY d.day
    """
)
def distinct_sketches(spark, folder):
    """Users of each day's last seven days, from stored daily sketches, within their error."""
    daily = load(spark, folder, "events").withColumn("day", F.to_date("ts"))
    stored = stage(sketches.distinct_sketches(daily, ["day"], "user_id"), "daily-sketches")
    week = sketches.with_distinct(sketches.trailing_sketches(stored, "day", 7))
    # The exact number, from the distinct users of each day.
    users = daily.select("day", "user_id").distinct()
    later = F.explode(F.sequence(F.lit(0), F.lit(6)))
    reached = users.withColumn("later", later).select(F.date_add("day", F.col("later")).alias("on"), "user_id")
    exact = reached.groupBy("on").agg(F.count_distinct("user_id").alias("users"))
    off = F.abs(F.col("distinct") - F.col("users"))
    near = off <= F.col("users") * sketches.distinct_error()
    return week.join(exact.hint("merge"), F.col("day") == F.col("on")).select(
        F.col("day").cast("string").alias("day"), near.alias("near"), F.col("rows").alias("events")
    )


HITTERS = {"user_id": 0.007, "props": 0.0105}


@query(
    " UNION ALL ".join(
        f"""
        SELECT '{n}' AS "column", CAST({n} AS VARCHAR) AS value, COUNT(*) AS "rows" FROM events
        GROUP BY {n} HAVING COUNT(*) >= {share} * (SELECT COUNT(*) FROM events)
        """
        for n, share in HITTERS.items()
    )
)
def heavy_hitters(spark, folder):
    """Users and properties above a share of all rows, without a shuffle of either."""
    events = load(spark, folder, "events")
    found = [
        sketches.heavy_hitters(events, n, share).select(
            F.lit(n).alias("column"), F.col("value").cast("string").alias("value"), "rows"
        )
        for n, share in HITTERS.items()
    ]
    return found[0].unionByName(found[1])


# ---------------------------------------------------------------- multisets

# Labels under two rules, without what tells rows of a user apart; some users are not known.
VERSIONS_SQL = f"""
WITH {LABELED_SQL},
old AS (SELECT CASE WHEN user_id % 10 > 0 THEN user_id END AS user_id, event_type, label FROM labeled),
new AS (
    SELECT CASE WHEN user_id % 10 > 0 THEN user_id END AS user_id, event_type,
           CAST(CASE WHEN event_type = 'error' AND counter >= 5 THEN 1 ELSE 0 END AS INTEGER) AS label
    FROM labeled WHERE event_type <> 'click' OR event_id % 3 > 0)
"""


def versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    def version(rule: SequenceRule, keep: str) -> DataFrame:
        known = F.when(F.col("user_id") % 10 > 0, F.col("user_id")).alias("user_id")
        labeled = consecutive_failures(events(spark, folder), rule).filter(keep)
        return labeled.select(known, "event_type", "label")

    return version(LOGINS, "true"), version(LONG_RUN, "event_type <> 'click' or event_id % 3 > 0")


@query(
    f"""
    {VERSIONS_SQL},
    net AS (
        SELECT user_id, event_type, label, CAST(SUM(n) AS BIGINT) AS times
        FROM (SELECT *, -1 AS n FROM old UNION ALL SELECT *, 1 FROM new)
        GROUP BY user_id, event_type, label HAVING SUM(n) <> 0)
    SELECT *, CASE WHEN MAX(times) OVER key > 0 AND MIN(times) OVER key < 0 THEN 'changed'
                   WHEN times > 0 THEN 'added' ELSE 'removed' END AS change
    FROM net WINDOW key AS (PARTITION BY user_id, event_type)
    """
)
def multiset_changes(spark, folder):
    """What a stricter rule and fewer clicks did to the labeled table."""
    old, new = versions(spark, folder)
    return difference.changes(old, new, ["user_id", "event_type"])


@query(f"{VERSIONS_SQL} SELECT * FROM old EXCEPT ALL SELECT * FROM new")
def except_all(spark, folder):
    return difference.except_all(*versions(spark, folder))


@query(f"{VERSIONS_SQL} SELECT * FROM old INTERSECT ALL SELECT * FROM new")
def intersect_all(spark, folder):
    return difference.intersect_all(*versions(spark, folder))


# ---------------------------------------------------------------- JSON texts

# Each event as a document around its properties; one in eleven is cut, one in seven missing.
JSON_SQL = """
(SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN left(j, 20) ELSE j END AS j
 FROM (SELECT event_id, '{"props": ' || props || ', "tags": ["' || event_type || '", null, {"user": ' || user_id
           || '}], "ok": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE '"maybe"' END || '}' AS j FROM events))
"""


def json_events(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "events").selectExpr(
        "event_id",
        """concat('{"props": ', props, ', "tags": ["', event_type, '", null, {"user": ', user_id,
           '}], "ok": ', if(event_id % 2 = 0, 'true', '"maybe"'), '}') AS j""",
    ).selectExpr("event_id", "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN left(j, 20) ELSE j END AS j")


@query(
    f"""
    WITH texts AS (SELECT j, json_valid(j) AS good FROM {JSON_SQL}),
    leaves AS (
        SELECT regexp_replace(t.fullkey, '[[][0-9]+[]]', '[]', 'g') AS path, t.type
        FROM (SELECT j FROM texts WHERE good), json_tree(j) t
        UNION ALL SELECT '$', CASE WHEN j IS NULL THEN 'MISSING' ELSE 'MALFORMED' END FROM texts
        WHERE j IS NULL OR NOT good)
    SELECT path, CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'NUMBER' WHEN type = 'VARCHAR' THEN 'STRING'
                      ELSE type END AS type, COUNT(*) AS "values"
    FROM leaves GROUP BY ALL
    """
)
def json_profile(spark, folder):
    """Paths, types and counts in a column of JSON texts."""
    return json_texts.json_profile(json_events(spark, folder), "j")


@query(
    f"""
    WITH texts AS (SELECT event_id, CASE WHEN json_valid(j) THEN j END AS j FROM {JSON_SQL})
    SELECT event_id, CAST(j ->> '$.props.k' AS BIGINT) AS k, j ->> '$.tags[0]' AS tag,
           CAST(j ->> '$.tags[2].user' AS BIGINT) AS "user",
           TRY_CAST(j ->> '$.ok' AS BOOLEAN) AS ok,
           j ->> '$.nothing' AS nothing
    FROM texts
    """
)
def json_values(spark, folder):
    """Chosen paths as typed columns; malformed texts have none."""
    paths = {
        "k": ("$.props.k", "bigint"), "tag": ("$.tags[0]", "string"), "user": ("$.tags[2].user", "bigint"),
        "ok": ("$.ok", "boolean"), "nothing": ("$.nothing", "string"),
    }
    return json_texts.json_values(json_events(spark, folder), "j", paths).drop("j")


# ---------------------------------------------------------------- regular series

HOUR = 3_600_000_000


@query(
    f"""
    WITH steps AS (
        SELECT event_type, epoch_us(ts) // {HOUR} * {HOUR} AS step, COUNT(*) AS events,
               MAX(value) AS highest FROM events GROUP BY ALL),
    calendar AS (
        SELECT event_type, unnest(generate_series(MIN(step), MAX(step), {HOUR})) AS step
        FROM steps GROUP BY event_type),
    filled AS (
        SELECT event_type, step, COALESCE(events, 0) AS events, highest
        FROM calendar LEFT JOIN steps USING (event_type, step))
    SELECT f.*, b.events AS events_before, f.events - b.events AS events_change
    FROM filled f LEFT JOIN filled b ON f.event_type = b.event_type AND b.step = f.step - 168 * {HOUR}
    """
)
def hourly_series(spark, folder):
    """Events per type and hour, empty hours filled, and the change against the week before."""
    values = {"events": ("count", F.lit(1)), "highest": ("max", F.col("value"))}
    hourly = series.regular_series(
        load(spark, folder, "events"), ["event_type"], "ts", timedelta(hours=1), values
    )
    return series.with_change(stage(hourly, "hourly"), ["event_type"], "events", timedelta(weeks=1))

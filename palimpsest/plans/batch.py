"""Batches of comparisons: job states, the cumulative output limit and the envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import batch_name, safe_error_code, safe_error_message
from palimpsest.schema import LIMITS

STATES = ("succeeded", "failed", "cancelled", "not-run")


def output_gate(jobs: DataFrame, limit: int = LIMITS["report_bytes"]) -> DataFrame:
    """``jobs(batch_id, seq, status, result_bytes, error)``: the job whose report passes ``limit`` fails, later ones weren't run."""
    own = Window.partitionBy("batch_id").orderBy("seq")
    done = F.when(F.col("status") == "succeeded", F.col("result_bytes")).otherwise(0)
    jobs = jobs.withColumn("_total", F.sum(done).over(own))
    over = F.col("_total") > limit
    before = F.max(over).over(own.rowsBetween(Window.unboundedPreceding, -1))
    jobs = jobs.withColumns({"_over": over, "_past": F.coalesce(before, F.lit(False))})
    first = F.col("_over") & ~F.col("_past")
    error = F.struct(F.lit("BATCH_OUTPUT_LIMIT").alias("code"), F.lit("the batch report would be too large").alias("message"))
    return jobs.withColumns(
        {
            "status": F.when(first, "failed").when(F.col("_past"), "not-run").otherwise(F.col("status")),
            "error": F.when(first, error).when(F.col("_past"), F.lit(None)).otherwise(F.col("error")),
        }
    ).drop("_total", "_over", "_past")


def cancel_after(jobs: DataFrame, seq: int) -> DataFrame:
    """The job ``seq`` is cancelled, with a default error; later ones weren't run."""
    error = F.coalesce("error", F.struct(F.lit("CANCELLED").alias("code"), F.lit("the comparison was cancelled").alias("message")))
    status = F.when(F.col("seq") == seq, "cancelled").when(F.col("seq") > seq, "not-run").otherwise(F.col("status"))
    return jobs.withColumns({"error": F.when(F.col("seq") == seq, error).when(F.col("seq") > seq, F.lit(None)).otherwise(F.col("error")), "status": status})


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("batch_id").agg(*[F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in STATES])


def job_fault(json: Column) -> Column:
    """Why a job can't be exported, or null: results and errors must fit the state."""
    status, error = F.col("status"), F.col("error").isNotNull()
    return (
        F.when(~F.coalesce(status.isin(*STATES), F.lit(False)), "unknown state")
        .when(~F.coalesce(F.col("job_id").rlike(r"^pair-[0-9]{1,6}$"), F.lit(False)), "bad id")
        .when((status == "succeeded") & (json.isNull() | error), "a success needs a result and no error")
        .when((status != "succeeded") & json.isNotNull(), "only a success has a result")
        .when((status == "failed") & ~error, "a failure needs an error")
        .when((status == "not-run") & error, "a job that wasn't run has no error")
    )


def batch_report(jobs: DataFrame) -> DataFrame:
    """One JSON envelope per batch of ``jobs(batch_id, seq, job_id, status, before_name, after_name, json, error)``.

    fault tells why a batch can't be exported: a faulty job, repeated ids, or more than 20 jobs.
    """
    quoted = lambda c: F.to_json(F.struct(c.alias("v")))
    text = lambda c: F.regexp_extract(quoted(c), r'(?s)^\{"v":(.*)\}$', 1)
    parts = [
        F.concat(F.lit('"id":'), text(F.col("job_id"))),
        F.concat(F.lit('"status":'), text(F.col("status"))),
        F.concat(F.lit('"beforeName":'), text(batch_name(F.col("before_name")))),
        F.concat(F.lit('"afterName":'), text(batch_name(F.col("after_name")))),
        F.when(F.col("json").isNotNull(), F.concat(F.lit('"result":'), F.col("json"))),
        F.when(F.col("error").isNotNull(), F.concat(F.lit('"error":{"code":'), text(safe_error_code(F.col("error.code"))), F.lit(',"message":'), text(safe_error_message(F.col("error.message"))), F.lit("}"))),
    ]
    one = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    told = jobs.select("batch_id", "seq", "job_id", "status", one.alias("one"), job_fault(F.col("json")).alias("fault"))
    per = told.groupBy("batch_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "one"))), lambda x: x["one"]).alias("jobs"),
        F.count(F.lit(1)).alias("n"), F.count_distinct("job_id").alias("ids"), F.min("fault").alias("fault"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATES],
    )
    names = {"succeeded": "succeeded", "failed": "failed", "cancelled": "cancelled", "not-run": "notRun"}
    summary = F.concat_ws(",", *[F.concat(F.lit(f'"{names[s]}":'), F.col(s).cast("string")) for s in STATES])
    json = F.concat(F.lit('{"schemaVersion":2,"reportKind":"batch","jobs":['), F.concat_ws(",", "jobs"), F.lit('],"summary":{'), summary, F.lit("}}"))
    fault = F.coalesce("fault", F.when(F.col("n") != F.col("ids"), "repeated ids"), F.when(F.col("n") > LIMITS["batch_jobs"], "too many jobs"))
    return per.select("batch_id", fault.alias("fault"), F.when(fault.isNull(), json).alias("json"), (F.octet_length(json) <= LIMITS["report_bytes"]).alias("fits"))

"""Reports over run logs, schedules, executions, waits and usage."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapewright.functions.binary import position_text
from shapewright.functions.numeric import int_divide, minutes_from_ms
from shapewright.functions.temporal import (
    canonical_text,
    day_number,
    decode_datetime,
    duration_text,
    millis_between,
    moment,
    seconds_between,
)
from shapewright.functions.text import contains_text, slice_by_bytes
from shapewright.operators.filters import decode, first_match, flagged, only, with_match, within_days
from shapewright.operators.joins import join_rollups, lookup, waits_with_holder
from shapewright.operators.ranking import sorted_if, top_rows
from shapewright.operators.recursion import follow, name_cycles
from shapewright.operators.sets import append_all
from shapewright.session import settle

RUN_LABELS = {"D": "Full", "I": "Differential", "L": "Transaction Log"}  # fixed values

# fixed values
FREQUENCY_LABELS = {
    1: "One Time",
    4: "Daily",
    8: "Weekly",
    16: "Monthly",
    32: "Monthly - relative",
    64: "When Agent Starts",
    128: "When Computer is idle",
}


def run_history(
    runs: DataFrame, media: DataFrame, name: str | None = None, kind: str | None = None, n: int = 1000, ties: list[str] = ()
) -> DataFrame:
    """Latest runs of one database and type, with their media, size and duration as text.

    runs: database_name, media_set_id, size, start_time, finish_time, type and any others;
    media: media_set_id, device_name. The filters come before the join.
    """
    chosen = only(only(runs, "database_name", name), "type", kind)
    joined = chosen.join(media, "media_set_id")
    newest = top_rows(joined, [F.col("start_time").desc(), F.col("finish_time"), *ties], n)
    size = F.col("size") / 1_000_000
    return newest.select(
        *[c for c in newest.columns if c not in ("size", "type")],
        F.concat(F.floor(size).cast("int").cast("string"), F.lit(" MB")).alias("size_text"),
        F.concat(seconds_between(F.col("start_time"), F.col("finish_time")).cast("string"), F.lit(" Seconds")).alias(
            "time_taken"
        ),
        decode(F.col("type"), RUN_LABELS).alias("run_type"),
    )


def schedule(
    jobs: DataFrame,
    steps: DataFrame,
    job_schedules: DataFrame,
    schedules: DataFrame,
    as_of: datetime | str,
    sort: bool = False,
) -> DataFrame:
    """Enabled jobs due on the day of ``as_of`` or the next, with steps and labels.

    jobs: job_id, job_name, enabled; steps: job_id, step_id, step_name, last_run_outcome;
    job_schedules: job_id, schedule_id, next_run_date, next_run_time; schedules: schedule_id,
    schedule_name, freq_type. The date bound removes jobs without a due schedule, so that join is inner.
    The join on another key stands between the two on the job, so that each of these shuffles for itself
    and a busy job can be split.
    """
    due = job_schedules.filter(F.col("next_run_date").between(day_number(as_of), day_number(as_of, 1)))
    joined = (
        flagged(jobs, enabled=1)
        .join(due, "job_id")
        .join(schedules, "schedule_id", "left")
        .join(steps, "job_id", "left")
    )
    report = joined.select(
        "job_name",
        "step_id",
        "step_name",
        "schedule_name",
        "next_run_date",
        "next_run_time",
        decode(F.col("freq_type"), FREQUENCY_LABELS, "Invalid").alias("frequency"),
        decode(F.col("enabled"), {1: "Enabled"}, "Disabled").alias("enabled"),
        decode(F.col("last_run_outcome"), {1: "Success"}, "Fail").alias("last_run_outcome"),
    )
    return sorted_if(report, sort, "next_run_date", "next_run_time", "job_name", "step_id")


def job_history(log: DataFrame, jobs: DataFrame, steps: DataFrame, sort: bool = False) -> DataFrame:
    """Distinct runs with their start as a timestamp and their duration as hh:mm:ss.

    log: job_id, step_id, run_date, run_time, run_duration (integers); jobs: job_id, job_name;
    steps: job_id, step_id, step_name.
    """
    joined = log.join(jobs, "job_id").join(steps, ["job_id", "step_id"])
    runs = joined.select(
        "job_name",
        "step_name",
        "job_id",
        "step_id",
        decode_datetime(F.col("run_date"), F.col("run_time")).alias("run_datetime"),
        duration_text(F.col("run_duration")).alias("run_duration"),
    ).distinct()
    return sorted_if(runs, sort, F.col("run_datetime").desc(), F.col("step_id").desc(), "job_name")


def execution_details(
    executions: DataFrame, operations: DataFrame, messages: DataFrame, events: DataFrame, project: str, runs: int = 10
) -> DataFrame:
    """A project's last runs with their operation, messages and events; runs without any of them stay.

    executions: execution_id, project_name; operations: operation_id, start_time, end_time;
    messages: operation_id, message_id, message_time, message; events: operation_id, message_id,
    package, path. The few run ids cut every log down before the logs meet.
    """
    last = top_rows(only(executions, "project_name", project), F.col("execution_id").desc(), runs)
    of_last = lambda df: with_match(df, last, {"operation_id": "execution_id"})
    rows = last.withColumn("operation_id", F.col("execution_id"))
    rows = rows.join(of_last(operations), "operation_id", "left").join(of_last(messages), "operation_id", "left")
    return rows.join(of_last(events), ["operation_id", "message_id"], "left")


def execution_errors(
    executions: DataFrame,
    operations: DataFrame,
    messages: DataFrame,
    events: DataFrame,
    project: str,
    runs: int = 10,
    pattern: str = "%Error%",
    n: int = 10_000,
    case_insensitive: bool = True,
) -> DataFrame:
    """First error messages, by time, of a project's last runs.

    executions: execution_id, project_name; operations: operation_id, start_time, end_time;
    messages: operation_id, message_id, message_time, message; events: operation_id, message_id,
    package, path. Rows whose package or path also has the pattern, or is NULL, are left out; that
    makes every outer join an inner one in effect.
    """
    last = top_rows(only(executions, "project_name", project), F.col("execution_id").desc(), runs)
    hit = lambda c: contains_text(F.col(c), pattern, case_insensitive)
    # each log is cut to the few runs before the logs meet
    of_last = lambda df: with_match(df, last, {"operation_id": "execution_id"})
    found = (
        of_last(messages.filter(hit("message")))
        .join(of_last(events.filter(~hit("package") & ~hit("path"))), ["operation_id", "message_id"])
        .join(of_last(operations), "operation_id", "left")
        .join(last, F.col("operation_id") == last["execution_id"])
        .drop("execution_id")
    )
    return top_rows(found, ["message_time", "message_id", "operation_id"], n)


def usage_stats(
    items: DataFrame, log: DataFrame, as_of: datetime | str | None = None, days: int = 60, sort: bool = False
) -> DataFrame:
    """Runs, drill-throughs, failures and mean times per item over the last days; unused items show 0.

    items: item_id, path, name; log: item_id, action, source, status, time_start, time_end,
    retrieval_ms, processing_ms, rendering_ms, row_count. One pass over the log instead of three;
    the item key is reduced before it is joined, so a busy item costs no skewed join. Means are cut to
    whole milliseconds, as AVG of INT does in T-SQL.
    """
    run = (F.col("action") == "Render") & (F.col("source") == "Live")
    drill = F.col("action").isin("DrillThrough", "Toggle") & (F.col("source") == "Session")
    measured = within_days(log, "time_start", days, as_of).select(
        "item_id",
        run.alias("_run"),
        drill.alias("_drill"),
        (F.col("status") != "rsSuccess").alias("_failed"),
        F.when(run, millis_between(F.col("time_start"), F.col("time_end"))).alias("execution"),
        *[F.when(run, F.col(f"{c}_ms").cast("long")).alias(c) for c in ("retrieval", "processing", "rendering")],
        F.when(run, F.col("row_count").cast("long")).alias("row_count"),
    )
    mean = lambda c: F.when(F.count(c) > 0, int_divide(F.sum(c), F.greatest(F.count(c), F.lit(1))))
    times = ("execution", "retrieval", "processing", "rendering")
    totals = measured.groupBy("item_id").agg(
        F.count_if("_run").alias("total_runs"),
        F.count_if("_drill").alias("total_drill_throughs"),
        F.count_if("_failed").alias("total_failures"),
        *[(mean(c) / F.lit(1000.0)).alias(f"avg_{c}_seconds") for c in times],
        mean("row_count").alias("avg_rows"),
    )
    report = join_rollups(items, [totals], "item_id", [c for c in totals.columns if c != "item_id"])
    return sorted_if(report, sort, F.col("total_runs").desc())


def access_counts(usage: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Reads, scans, lookups and writes per object with last read and scan; an unknown object is N/A.

    usage: object_id, index_id, action (seek, scan, lookup, update), at; catalogue: object_id, name.
    """
    of = lambda action: F.col("action") == action
    counted = usage.groupBy("object_id", "index_id").agg(
        F.count_if(of("seek")).alias("seeks"),
        F.count_if(of("scan")).alias("scans"),
        F.count_if(of("lookup")).alias("lookups"),
        F.count_if(of("update")).alias("writes"),
        F.max(F.when(of("seek"), F.col("at"))).alias("last_seek"),
        F.max(F.when(of("scan"), F.col("at"))).alias("last_scan"),
    )
    kind = first_match(
        [(F.col("index_id") == 0, F.lit("HEAP")), (F.col("index_id") == 1, F.lit("CLUSTERED INDEX"))],
        F.lit("UNCLUSTERED INDEX"),
    )
    named = lookup(counted, catalogue, "object_id", "object_id", {"object_name": "name"})
    return named.withColumn("object_name", F.coalesce("object_name", F.lit("N/A"))).withColumn("kind", kind)


def wait_chains(waits: DataFrame, holders: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each wait with the session that holds its resource, both sessions named and with their text.

    waits: resource, session_id, mode; holders: resource, blocking_session_id; sessions: session_id,
    login, text. The session table is joined once for each role.
    """
    who = sessions.select(
        F.col("session_id"), F.col("login").alias("requesting_login"), F.col("text").alias("requesting_text")
    )
    blocker = sessions.select(
        F.col("session_id").alias("blocking_session_id"),
        F.col("login").alias("blocking_login"),
        F.col("text").alias("blocking_text"),
    )
    chains = waits_with_holder(waits, holders, "resource", keep_free=False).drop(holders["resource"])
    return chains.join(who, "session_id").join(blocker, "blocking_session_id")


def blocking_chains(waits: DataFrame, holders: DataFrame) -> DataFrame:
    """Each waiting session with the head of its chain: the session at the end, which waits for none.

    session_id, blocking_session_id, head_blocker, depth (sessions between them and the head included), deadlock (the smallest
    session of the cycle that the chain runs into, else NULL; then there is no head and no depth) and in_deadlock
    (whether the session is one of the cycle). A session that waits for several is followed by the smallest of them.
    Waiting for oneself does not count. waits: resource, session_id; holders: resource, blocking_session_id.
    """
    pairs = waits_with_holder(waits.select("resource", "session_id"), holders, "resource", keep_free=False)
    other = F.col("session_id") != F.col("blocking_session_id")
    waiting = pairs.filter(other).groupBy("session_id").agg(F.min("blocking_session_id").alias("blocking_session_id"))
    waiting = settle(waiting, "waiting")
    blockers = waiting.select(F.col("blocking_session_id").alias("session_id")).distinct()
    free = blockers.join(waiting, "session_id", "left_anti").withColumn("blocking_session_id", F.lit(None).cast("long"))
    ended, looped = follow(append_all(waiting, free), "session_id", "blocking_session_id")
    chains = ended.filter("steps > 0").select(
        F.col("id").alias("session_id"), F.col("last").alias("head_blocker"), F.col("steps").alias("depth"),
        F.lit(None).cast("long").alias("deadlock"), F.lit(False).alias("in_deadlock"),
    )
    locked = name_cycles(looped).select(
        F.col("id").alias("session_id"), F.lit(None).cast("long").alias("head_blocker"), F.lit(None).cast("long").alias("depth"),
        F.col("cycle").alias("deadlock"), F.col("on_cycle").alias("in_deadlock"),
    )
    return waiting.join(append_all(chains, locked), "session_id")


def active_requests(
    sessions: DataFrame, requests: DataFrame, as_of: datetime | str | None = None, sort: bool = False
) -> DataFrame:
    """All sessions with their running request, if any: minutes so far, expected end, current statement.

    sessions: session_id and any others; requests: session_id, percent_complete, elapsed_ms,
    remaining_ms, text, start_offset, end_offset.
    """
    running = requests.select(
        "session_id",
        F.col("percent_complete").cast("decimal(6,2)").alias("percent_complete"),
        minutes_from_ms(F.col("elapsed_ms")).alias("elapsed_min"),
        minutes_from_ms(F.col("remaining_ms")).alias("eta_min"),
        canonical_text(F.timestamp_add("MICROSECOND", F.col("remaining_ms") * 1000, moment(as_of))).alias("eta"),
        slice_by_bytes(F.col("text"), F.col("start_offset"), F.col("end_offset")).alias("statement"),
    )
    return sorted_if(sessions.join(running, "session_id", "left"), sort, F.col("elapsed_min").desc())


def log_records(log: DataFrame, sort: bool = False) -> DataFrame:
    """Log records with a begin time or a unit; the hexadecimal position also in decimal.

    log: position, begin_time, unit and any others.
    """
    kept = log.filter(F.col("begin_time").isNotNull() | F.col("unit").isNotNull())
    report = kept.withColumn("position_decimal", position_text(F.col("position")))
    return sorted_if(report, sort, F.col("begin_time").desc())


def staleness(log: DataFrame, key: str, ts: str, sort: bool = False) -> DataFrame:
    """Last refresh of each object."""
    report = log.groupBy(key).agg(F.max(ts).alias("last_update"))
    return sorted_if(report, sort, F.col("last_update").desc())

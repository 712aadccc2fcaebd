"""Queries that run the report jobs, with the given tables in the place of logs and catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from shapewright.functions.temporal import date_to_int, time_to_int
from shapewright.functions.text import fill_template
from shapewright.operators.numbering import lag_lead
from shapewright.operators.ranking import latest_per_key
from shapewright.plans.access import database_roles, grant_lines, membership_matrix, role_grants, server_roles
from shapewright.plans.activity import (
    access_counts,
    active_requests,
    blocking_chains,
    execution_details,
    execution_errors,
    job_history,
    log_records,
    run_history,
    schedule,
    staleness,
    usage_stats,
    wait_chains,
)
from shapewright.plans.capacity import keyspace_used, range_partitions, space_report, space_totals
from shapewright.plans.catalogue import (
    advice_expand,
    catalogue_search,
    child_lines,
    key_lists,
    subscriptions,
    threshold_report,
)
from shapewright.plans.queries_relational import PRIORITIES, WITH_PARENT, with_parent
from shapewright.plans.registry import query
from shapewright.session import settle
from shapewright.sources.tables import column_profile, profile_tables

AS_OF = "2024-01-31"


@query(
    """SELECT database_name, media_set_id, start_time, finish_time, device_name, line,
    CAST(CAST(floor(size / 1000000) AS INT) AS VARCHAR) || ' MB' AS size_text,
    CAST(datediff('second', start_time, finish_time) AS VARCHAR) || ' Seconds' AS time_taken,
    CASE type WHEN 'D' THEN 'Full' WHEN 'I' THEN 'Differential' WHEN 'L' THEN 'Transaction Log' END AS run_type FROM
    (SELECT o_orderpriority AS database_name, l_orderkey AS media_set_id, l_extendedprice * 1000 AS size, o_orderdate AS start_time,
      l_shipdate AS finish_time, o_orderstatus AS device_name, l_linenumber AS line, l_partkey,
      CASE l_returnflag WHEN 'A' THEN 'D' WHEN 'N' THEN 'I' ELSE 'L' END AS type
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    WHERE database_name = '1-URGENT' AND type = 'D'
    ORDER BY start_time DESC, finish_time, media_set_id, line, l_partkey, size LIMIT 1000""",
    "run_history",
)
def order_runs(t):
    kind = F.when(F.col("l_returnflag") == "A", "D").when(F.col("l_returnflag") == "N", "I").otherwise("L")
    runs = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderpriority").alias("database_name"),
        F.col("l_orderkey").alias("media_set_id"),
        (F.col("l_extendedprice") * 1000).alias("size"),
        F.col("o_orderdate").alias("start_time"),
        F.col("l_shipdate").alias("finish_time"),
        F.col("l_linenumber").alias("line"),
        "l_partkey",
        kind.alias("type"),
    )
    media = t.orders.select(F.col("o_orderkey").alias("media_set_id"), F.col("o_orderstatus").alias("device_name"))
    ties = ["media_set_id", "line", "l_partkey", "size"]
    return run_history(runs, media, "1-URGENT", "D", 1000, ties).drop("l_partkey")


@query(
    """SELECT 'orders' AS table_name, 'o_orderkey' AS column_name, 'int' AS data_type, max(o_orderkey) AS current_value,
      CAST(2147483647 AS BIGINT) AS max_value, max(o_orderkey) / 2147483647 AS share_used FROM orders
    UNION ALL SELECT 'events', 'event_id', 'int', max(event_id), 2147483647, max(event_id) / 2147483647 FROM events
    UNION ALL SELECT 'part', 'p_partkey', 'int', max(p_partkey), 2147483647, max(p_partkey) / 2147483647 FROM part""",
    "keyspace_used",
)
def key_shares(t):
    keys = {"orders": (t.orders, "o_orderkey"), "events": (t.events, "event_id"), "part": (t.part, "p_partkey")}
    return keyspace_used(keys, 0.0, "int")


@query(
    """SELECT r.n AS range_no, CASE WHEN r.n > 1 THEN (r.n - 1) * 2000 END AS lower_bound,
    CASE WHEN r.n <= m.last THEN r.n * 2000 END AS upper_bound, coalesce(c.rows, 0) AS rows, r.n > m.last AS is_open,
    m.max_key, nullif(m.last, 0) * 2000 - m.max_key AS headroom, nullif(m.last, 0) * 2000 - m.max_key < 8000000 AS needs_split
    FROM (SELECT max(o_orderkey) AS max_key, max(o_orderkey) // 2000 AS last FROM orders) m,
    LATERAL (SELECT unnest(generate_series(1, m.last + 1)) AS n) r
    LEFT JOIN (SELECT o_orderkey // 2000 + 1 AS n, count(*) AS rows FROM orders GROUP BY 1) c ON c.n = r.n""",
    "range_partitions",
)
def order_ranges(t):
    return range_partitions(t.orders, "o_orderkey", every=2000)


@query(
    """SELECT b.n AS range_no, b.lo AS lower_bound, b.hi AS upper_bound, count(o_orderkey) AS rows, b.hi IS NULL AS is_open,
    (SELECT max(o_orderkey) FROM orders) AS max_key, 5000 - (SELECT max(o_orderkey) FROM orders) AS headroom,
    5000 - (SELECT max(o_orderkey) FROM orders) < 8000000 AS needs_split
    FROM (VALUES (CAST(1 AS BIGINT), CAST(NULL AS BIGINT), CAST(10 AS BIGINT)), (2, 10, 700), (3, 700, 5000), (4, 5000, NULL)) b(n, lo, hi)
    LEFT JOIN orders ON (lo IS NULL OR o_orderkey >= lo) AND (hi IS NULL OR o_orderkey < hi) GROUP BY b.n, b.lo, b.hi"""
)
def range_partitions_uneven(t):
    return range_partitions(t.orders, "o_orderkey", bounds=[10, 700, 5000])


@query(
    """WITH b AS (SELECT DISTINCT l_orderkey AS b FROM lineitem WHERE l_orderkey % 3 = 0),
    n AS (SELECT row_number() OVER (ORDER BY b) AS n, lag(b) OVER (ORDER BY b) AS lo, b AS hi FROM b UNION ALL SELECT count(*) + 1, max(b), NULL FROM b),
    m AS (SELECT max(o_orderkey) AS top, (SELECT max(b) FROM b) AS last FROM orders)
    SELECT n.n AS range_no, lo AS lower_bound, hi AS upper_bound, count(o_orderkey) AS rows, hi IS NULL AS is_open, any_value(m.top) AS max_key,
    any_value(m.last - m.top) AS headroom, any_value(m.last - m.top) < 8000000 AS needs_split
    FROM n CROSS JOIN m LEFT JOIN orders ON (lo IS NULL OR o_orderkey >= lo) AND (hi IS NULL OR o_orderkey < hi) GROUP BY n.n, lo, hi"""
)
def range_partitions_many(t):
    """Bounds taken from a table, as many as it has."""
    bounds = t.lineitem.filter("l_orderkey % 3 = 0").select("l_orderkey")
    return range_partitions(t.orders, "o_orderkey", bounds=bounds)


@query(
    """SELECT user_id AS object_id, index_id, seeks, scans, lookups, writes, last_seek, last_scan, coalesce(c_name, 'N/A') AS object_name,
    CASE index_id WHEN 0 THEN 'HEAP' WHEN 1 THEN 'CLUSTERED INDEX' ELSE 'UNCLUSTERED INDEX' END AS kind FROM
    (SELECT user_id, user_id % 3 AS index_id, count(*) FILTER (event_type = 'click') AS seeks, count(*) FILTER (event_type = 'view') AS scans,
      count(*) FILTER (event_type = 'signup') AS lookups, count(*) FILTER (event_type = 'purchase') AS writes,
      max(ts) FILTER (event_type = 'click') AS last_seek, max(ts) FILTER (event_type = 'view') AS last_scan FROM events GROUP BY 1)
    LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING') ON user_id = c_custkey""",
    "access_counts",
)
def user_access(t):
    kinds = {"click": "seek", "view": "scan", "signup": "lookup", "purchase": "update"}
    action = F.col("event_type")
    for event, word in kinds.items():
        action = F.when(F.col("event_type") == event, F.lit(word)).otherwise(action)
    usage = t.events.select(
        F.col("user_id").alias("object_id"), (F.col("user_id") % 3).alias("index_id"), action.alias("action"), F.col("ts").alias("at")
    )
    named = t.customer.filter(F.col("c_mktsegment") == "BUILDING")
    return access_counts(usage, named.select(F.col("c_custkey").alias("object_id"), F.col("c_name").alias("name")))


SITE = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"


@query(
    f"""WITH i AS (SELECT page_id, url, {SITE} AS site, split_part(url, '/', 4) AS lang, html FROM pages),
    s AS (SELECT site, min(page_id) AS link FROM i GROUP BY site)
    SELECT i.page_id AS item_id, i.url AS path, i.site AS name, i.lang AS type, i.site AS source_name, s.link, p.url AS source_path
    FROM i LEFT JOIN s ON i.site = s.site LEFT JOIN pages p ON p.page_id = s.link
    WHERE i.lang IN ('en', 'fr') AND length(rtrim(i.site)) <> 0 AND i.html ILIKE '%THE%'""",
    "catalogue_search",
)
def page_search(t):
    items = t.pages.select(
        F.col("page_id").alias("item_id"),
        F.col("url").alias("path"),
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("name"),
        F.split_part("url", F.lit("/"), F.lit(4)).alias("type"),
        F.encode("html", "UTF-8").alias("content"),
    )
    # settled, so that the join shuffles both sides itself and a hot site can be split
    homes = settle(items.groupBy("name").agg(F.min("item_id").alias("link")))
    sources = items.select("item_id", F.col("name").alias("source_name")).join(
        homes, F.col("source_name") == homes["name"]
    )
    return catalogue_search(items, sources.select("item_id", "source_name", "link"), ["en", "fr"], "%THE%")


@query(
    """SELECT l_orderkey AS subscription_id, l_partkey AS item_id, l_suppkey AS owner_id, o_custkey AS schedule_id,
    l_shipdate AS last_run, s_name AS owner_name, p_name AS item_name, c_name AS schedule_name
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
    JOIN (SELECT DISTINCT l_partkey AS bp, l_orderkey AS bo, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      WHERE l_returnflag = 'R') ON bp = l_partkey AND bo = l_orderkey
    JOIN customer ON o_custkey = c_custkey""",
    "subscriptions",
)
def line_subscriptions(t):
    subs = t.lineitem.select(
        F.col("l_partkey").alias("item_id"),
        F.col("l_orderkey").alias("subscription_id"),
        F.col("l_suppkey").alias("owner_id"),
        F.col("l_shipdate").alias("last_run"),
    )
    returned = t.lineitem.filter(F.col("l_returnflag") == "R").select("l_partkey", "l_orderkey").distinct()
    bridge = returned.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_partkey").alias("item_id"), F.col("l_orderkey").alias("subscription_id"), F.col("o_custkey").alias("schedule_id")
    )
    return subscriptions(
        subs,
        t.supplier.select(F.col("s_suppkey").alias("owner_id"), F.col("s_name").alias("owner_name")),
        t.part.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_name")),
        bridge,
        t.customer.select(F.col("c_custkey").alias("schedule_id"), F.col("c_name").alias("schedule_name")),
    )


@query(
    """WITH e AS (SELECT user_id, event_type, CAST(round(value * 1000) AS BIGINT) AS ms, event_id FROM events
      WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAYS),
    u AS (SELECT user_id, count(*) FILTER (event_type IN ('view', 'purchase')) AS total_runs, count(*) FILTER (event_type IN ('click', 'signup')) AS total_drill_throughs,
      count(*) FILTER (event_type = 'error') AS total_failures,
      CAST(sum(ms) FILTER (event_type IN ('view', 'purchase')) // count(*) FILTER (event_type IN ('view', 'purchase')) AS BIGINT) / 1000 AS avg_execution_seconds,
      CAST(sum(event_id % 50) FILTER (event_type IN ('view', 'purchase')) // count(*) FILTER (event_type IN ('view', 'purchase')) AS BIGINT) / 1000 AS avg_retrieval_seconds,
      CAST(sum(event_id % 70) FILTER (event_type IN ('view', 'purchase')) // count(*) FILTER (event_type IN ('view', 'purchase')) AS BIGINT) / 1000 AS avg_processing_seconds,
      CAST(sum(event_id % 90) FILTER (event_type IN ('view', 'purchase')) // count(*) FILTER (event_type IN ('view', 'purchase')) AS BIGINT) / 1000 AS avg_rendering_seconds,
      CAST(sum(event_id % 100) FILTER (event_type IN ('view', 'purchase')) // count(*) FILTER (event_type IN ('view', 'purchase')) AS BIGINT) AS avg_rows FROM e GROUP BY user_id)
    SELECT c_custkey AS item_id, c_mktsegment AS path, c_name AS name, coalesce(total_runs, 0) AS total_runs,
    coalesce(total_drill_throughs, 0) AS total_drill_throughs, coalesce(total_failures, 0) AS total_failures,
    coalesce(avg_execution_seconds, 0) AS avg_execution_seconds, coalesce(avg_retrieval_seconds, 0) AS avg_retrieval_seconds,
    coalesce(avg_processing_seconds, 0) AS avg_processing_seconds, coalesce(avg_rendering_seconds, 0) AS avg_rendering_seconds,
    coalesce(avg_rows, 0) AS avg_rows FROM customer LEFT JOIN u ON c_custkey = user_id WHERE c_acctbal >= 0""",
    "usage_stats",
)
def customer_usage(t):
    kind = F.col("event_type")
    run = kind.isin("view", "purchase")
    log = t.events.select(
        F.col("user_id").alias("item_id"),
        F.when(run, "Render").when(kind == "click", "DrillThrough").when(kind == "signup", "Toggle").alias("action"),
        F.when(run, "Live").otherwise("Session").alias("source"),
        F.when(kind == "error", "rsFailed").otherwise("rsSuccess").alias("status"),
        F.col("ts").alias("time_start"),
        F.timestamp_add("MICROSECOND", F.round(F.col("value") * 1000).cast("long") * 1000, F.col("ts")).alias("time_end"),
        (F.col("event_id") % 50).alias("retrieval_ms"),
        (F.col("event_id") % 70).alias("processing_ms"),
        (F.col("event_id") % 90).alias("rendering_ms"),
        (F.col("event_id") % 100).alias("row_count"),
    )
    shown = t.customer.filter(F.col("c_acctbal") >= 0)
    items = shown.select(
        F.col("c_custkey").alias("item_id"), F.col("c_mktsegment").alias("path"), F.col("c_name").alias("name")
    )
    return usage_stats(items, log, AS_OF, 10)


@query(
    """SELECT c_name AS job_name, o_orderkey AS step_id, o_orderpriority AS step_name, event_type AS schedule_name,
    CAST(strftime(ts, '%Y%m%d') AS INT) AS next_run_date, CAST(strftime(ts, '%H%M%S') AS INT) AS next_run_time,
    CASE event_id % 8 WHEN 0 THEN 'One Time' WHEN 2 THEN 'Daily' WHEN 3 THEN 'Weekly' WHEN 4 THEN 'Monthly' WHEN 5 THEN 'Monthly - relative'
      WHEN 6 THEN 'When Agent Starts' WHEN 7 THEN 'When Computer is idle' ELSE 'Invalid' END AS frequency,
    'Enabled' AS enabled, CASE WHEN o_orderstatus = 'F' THEN 'Success' ELSE 'Fail' END AS last_run_outcome
    FROM customer JOIN events ON user_id = c_custkey LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON o_custkey = c_custkey
    WHERE c_acctbal >= 0 AND CAST(strftime(ts, '%Y%m%d') AS INT) BETWEEN 20240129 AND 20240130""",
    "schedule",
)
def event_schedule(t):
    jobs = t.customer.select(
        F.col("c_custkey").alias("job_id"), F.col("c_name").alias("job_name"), (F.col("c_acctbal") >= 0).cast("int").alias("enabled")
    )
    steps = t.orders.filter(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_custkey").alias("job_id"),
        F.col("o_orderkey").alias("step_id"),
        F.col("o_orderpriority").alias("step_name"),
        (F.col("o_orderstatus") == "F").cast("int").alias("last_run_outcome"),
    )
    job_schedules = t.events.select(
        F.col("user_id").alias("job_id"),
        F.col("event_id").alias("schedule_id"),
        date_to_int(F.col("ts")).alias("next_run_date"),
        time_to_int(F.col("ts")).alias("next_run_time"),
    )
    schedules = t.events.select(
        F.col("event_id").alias("schedule_id"),
        F.col("event_type").alias("schedule_name"),
        F.expr("shiftleft(1, cast(event_id % 8 AS int))").alias("freq_type"),
    )
    return schedule(jobs, steps, job_schedules, schedules, "2024-01-29")


@query(
    """SELECT DISTINCT c_name AS job_name, event_type AS step_name, user_id AS job_id, CAST(ascii(event_type) AS BIGINT) AS step_id,
    date_trunc('second', ts) AS run_datetime, lpad(CAST(d // 10000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(d // 100 % 100 AS VARCHAR), 2, '0') || ':' ||
    lpad(CAST(d % 100 AS VARCHAR), 2, '0') AS run_duration
    FROM (SELECT *, event_id % 24 * 10000 + event_id % 60 * 100 + event_id % 7 AS d FROM events) JOIN customer ON user_id = c_custkey""",
    "job_history",
)
def event_runs(t):
    step = F.ascii("event_type").cast("long").alias("step_id")
    e = F.col("event_id")
    log = t.events.select(
        F.col("user_id").alias("job_id"),
        step,
        date_to_int(F.col("ts")).alias("run_date"),
        time_to_int(F.col("ts")).alias("run_time"),
        (e % 24 * 10000 + e % 60 * 100 + e % 7).alias("run_duration"),
    )
    steps = t.events.select(F.col("user_id").alias("job_id"), step, F.col("event_type").alias("step_name")).distinct()
    jobs = t.customer.select(F.col("c_custkey").alias("job_id"), F.col("c_name").alias("job_name"))
    return job_history(log, jobs, steps)


@query(
    """WITH x AS (SELECT user_id AS execution_id, max(event_id) AS last_id FROM events GROUP BY user_id),
    top AS (SELECT * FROM x ORDER BY last_id DESC LIMIT 10)
    SELECT user_id AS operation_id, event_id AS message_id, ts AS message_time, 'An ' || event_type || ' at ' || props AS message,
    nullif(props, '{"k": 3}') AS package, CASE WHEN value < 5 THEN '/OnError/x' ELSE '/run/' || CAST(event_id AS VARCHAR) END AS path,
    c_name AS caller, 'p' AS project_name FROM events JOIN top ON user_id = execution_id LEFT JOIN customer ON user_id = c_custkey
    WHERE event_type ILIKE '%error%' AND props <> '{"k": 3}' AND value >= 5
    ORDER BY ts, event_id LIMIT 10000""",
    "execution_errors",
)
def event_errors(t):
    executions, operations, messages, events = execution_tables(t)
    found = execution_errors(executions, operations, messages, events, "p")
    return found.drop("operation_id").withColumnRenamed("user_id", "operation_id")


@query(
    """WITH x AS (SELECT user_id AS u, max(event_id) AS execution_id FROM events GROUP BY user_id),
    top AS (SELECT * FROM x ORDER BY execution_id DESC LIMIT 10)
    SELECT execution_id, execution_id AS operation_id, event_id AS message_id, ts AS message_time, 'An ' || event_type || ' at ' || props AS message,
    nullif(props, '{"k": 3}') AS package, CASE WHEN value < 5 THEN '/OnError/x' ELSE '/run/' || CAST(event_id AS VARCHAR) END AS path,
    c_name AS caller, 'p' AS project_name, user_id FROM top JOIN events ON user_id = u LEFT JOIN customer ON user_id = c_custkey""",
    "execution_details",
)
def event_details(t):
    return execution_details(*execution_tables(t), "p")


def execution_tables(t):
    """Executions, operations, messages and event places made of the events of each user."""
    last = settle(t.events.groupBy("user_id").agg(F.max("event_id").alias("last_id")))
    # the report takes the largest ids, so an execution is numbered by its last event
    executions = last.select(F.col("last_id").alias("execution_id"), F.lit("p").alias("project_name"))
    run = t.events.join(last, "user_id")
    messages = run.select(
        F.col("last_id").alias("operation_id"),
        F.col("event_id").alias("message_id"),
        F.col("ts").alias("message_time"),
        F.concat(F.lit("An "), "event_type", F.lit(" at "), "props").alias("message"),
        "user_id",
    )
    e = F.col("event_id")
    package = F.nullif(F.col("props"), F.lit('{"k": 3}'))
    path = F.when(F.col("value") < 5, "/OnError/x").otherwise(F.concat(F.lit("/run/"), e.cast("string")))
    events = run.select(
        F.col("last_id").alias("operation_id"), F.col("event_id").alias("message_id"), package.alias("package"), path.alias("path")
    )
    operations = last.join(t.customer, F.col("user_id") == F.col("c_custkey")).select(
        F.col("last_id").alias("operation_id"), F.col("c_name").alias("caller")
    )
    return executions, operations, messages, events


ROLES = "CASE WHEN n_nationkey % 2 = 0 THEN 'db_' || r_name ELSE r_name END"
SERVER_ROLES = ["sysadmin"] + PRIORITIES[1:] + ["ControlServer"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
DATABASE_ROLES = [f"db_{r}" for r in REGIONS] + REGIONS
MATRIX = ", ".join(f"count(*) FILTER (role_name = '{r}') AS \"{r}\"" for r in SERVER_ROLES + DATABASE_ROLES)
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    f"""SELECT server_name, database_name, login_type, login_name, {MATRIX} FROM (
    SELECT DISTINCT 'srv' AS server_name, '(server)' AS database_name, c_mktsegment AS login_type, c_name AS login_name,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'sysadmin' ELSE o_orderpriority END AS role_name
      FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0
    UNION ALL SELECT 'srv', '(server)', c_mktsegment, c_name, 'ControlServer' FROM orders JOIN customer ON o_custkey = c_custkey
      WHERE o_totalprice > 450000 AND o_orderstatus = 'F'
    UNION ALL SELECT 'srv', '[' || c_mktsegment || ']', CASE WHEN c_custkey % 2 = 0 THEN 'SQL_LOGIN' ELSE 'WINDOWS_LOGIN' END, c_name, {ROLES}
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      WHERE c_acctbal >= 0)
    GROUP BY server_name, database_name, login_type, login_name""",
    "membership_matrix",
)
def customer_matrix(t):
    server, databases = customer_roles(t)
    return membership_matrix(server, databases)


def customer_roles(t):
    disabled = (F.col("c_acctbal") < 0).cast("int").alias("is_disabled")
    role_id = -F.left("o_orderpriority", F.lit(1)).cast("long")
    people = t.customer.select(
        F.col("c_custkey").alias("principal_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type_desc"), disabled
    )
    role_name = F.when(F.col("o_orderpriority") == "1-URGENT", "sysadmin").otherwise(F.col("o_orderpriority"))
    roles = t.orders.select(role_id.alias("principal_id"), role_name.alias("name")).distinct()
    roles = roles.withColumn("type_desc", F.lit("SERVER_ROLE")).withColumn("is_disabled", F.lit(0))
    memberships = t.orders.select(role_id.alias("role_id"), F.col("o_custkey").alias("member_id")).distinct()
    grants = t.orders.filter(F.col("o_totalprice") > 450000).select(
        F.col("o_custkey").alias("grantee_id"),
        F.lit(100).alias("class"),
        F.lit("CL").alias("type"),
        F.when(F.col("o_orderstatus") == "F", "G").otherwise("D").alias("state"),
    )
    server = server_roles(memberships, people.unionByName(roles), grants, "srv")
    homes = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    member = t.customer.join(homes, F.col("c_nationkey") == F.col("n_nationkey"))
    role = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("db_"), "r_name")).otherwise(F.col("r_name"))
    login = F.when(F.col("c_custkey") % 2 == 0, "SQL_LOGIN").otherwise("WINDOWS_LOGIN")
    rows = member.select(
        "c_mktsegment", login.alias("login_type"), F.col("c_name").alias("login_name"), role.alias("role_name"), disabled
    )
    one = lambda segment: rows.filter(F.col("c_mktsegment") == segment).drop("c_mktsegment")
    return server, database_roles({s: one(s) for s in SEGMENTS}, "srv")


def permission_tables(t):
    """Principals, permissions, schemas, objects and types made of nations, customers, regions and suppliers."""
    principals = t.nation.select(
        F.col("n_nationkey").cast("long").alias("principal_id"),
        F.col("n_name").alias("name"),
        F.when(F.col("n_regionkey") < 4, "DATABASE_ROLE").otherwise("SQL_USER").alias("type_desc"),
    )
    k = F.col("c_custkey")
    names = ["DATABASE", "SCHEMA", "OBJECT_OR_COLUMN", "OBJECT_OR_COLUMN", "TYPE", "CERTIFICATE", "SYMMETRIC_KEYS", "ASSEMBLY"]
    kind = F.element_at(F.array(*[F.lit(n) for n in names]), (k % 8 + 1).cast("int"))
    major = F.when(k % 8 == 1, k % 7).when(k % 8 == 4, 1_000_000_000_000 + k % 6).otherwise(1_000_000_000_000 + 10 + k % 200)
    permissions = t.customer.select(
        F.col("c_nationkey").cast("long").alias("grantee_id"),
        kind.alias("class_desc"),
        major.alias("major_id"),
        F.col("c_mktsegment").alias("permission_name"),
        F.when(F.col("c_acctbal") < 0, "DENY").otherwise("GRANT").alias("state_desc"),
    )
    schemas = t.region.select(F.col("r_regionkey").cast("long").alias("schema_id"), F.col("r_name").alias("name"))
    objects = t.supplier.select(
        (F.col("s_suppkey") + 1_000_000_000_010).alias("object_id"),
        F.col("s_name").alias("name"),
        (F.col("s_nationkey") % 5).cast("long").alias("schema_id"),
        F.when(F.col("s_suppkey") % 10 == 0, "SYSTEM_TABLE").otherwise("USER_TABLE").alias("type_desc"),
    )
    types = t.region.select(
        (F.col("r_regionkey") + 1_000_000_000_000).alias("type_id"),
        F.lower("r_name").alias("name"),
        F.col("r_regionkey").cast("long").alias("schema_id"),
    )
    return principals, permissions, schemas, objects, types


PERMISSION_TABLES = """p AS (SELECT n_nationkey AS pid, n_name AS pname, CASE WHEN n_regionkey < 4 THEN 'DATABASE_ROLE' ELSE 'SQL_USER' END AS ptype FROM nation),
    d AS (SELECT c_nationkey AS gid, (['DATABASE', 'SCHEMA', 'OBJECT_OR_COLUMN', 'OBJECT_OR_COLUMN', 'TYPE', 'CERTIFICATE', 'SYMMETRIC_KEYS', 'ASSEMBLY'])[c_custkey % 8 + 1] AS cls,
      CASE c_custkey % 8 WHEN 1 THEN c_custkey % 7 WHEN 4 THEN 1000000000000 + c_custkey % 6 ELSE 1000000000010 + c_custkey % 200 END AS major,
      c_mktsegment AS perm, CASE WHEN c_acctbal < 0 THEN 'DENY' ELSE 'GRANT' END AS state FROM customer),
    o AS (SELECT s_suppkey + 1000000000010 AS oid, s_name AS oname, s_nationkey % 5 AS osid, CASE WHEN s_suppkey % 10 = 0 THEN 'SYSTEM_TABLE' ELSE 'USER_TABLE' END AS otype FROM supplier),
    y AS (SELECT r_regionkey + 1000000000000 AS tid, lower(r_name) AS tname, r_name AS tschema FROM region)"""


@query(
    f"""WITH {PERMISSION_TABLES} SELECT DISTINCT 'db1' AS database_name, pname AS role_name, cls AS permission_type, perm AS permission_name,
    state AS state_desc, CASE WHEN otype IS NULL OR otype = 'SYSTEM_TABLE' THEN cls ELSE otype END AS object_type, s.r_name AS schema_name,
    coalesce(ss.r_name, oname) AS object_name FROM p JOIN d ON gid = pid LEFT JOIN region ss ON major = ss.r_regionkey
    LEFT JOIN o ON major = oid LEFT JOIN region s ON s.r_regionkey = osid WHERE ptype = 'DATABASE_ROLE' AND cls <> 'DATABASE'""",
    "role_grants",
)
def nation_grants(t):
    principals, permissions, schemas, objects, _ = permission_tables(t)
    return role_grants(principals, permissions, schemas, objects, "db1")


@query(
    f"""WITH {PERMISSION_TABLES}, m AS (SELECT '[' || c_mktsegment || ']' AS db, c_name AS u, {ROLES} AS r
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      WHERE c_acctbal >= 0),
    g AS (SELECT 'USE [db1] ' || CASE cls WHEN 'OBJECT_OR_COLUMN' THEN state || ' ' || perm || ' ON [' || s.r_name || '].[' || oname || '] TO [' || pname || ']'
      WHEN 'SCHEMA' THEN state || ' ' || perm || ' ON SCHEMA :: [' || ss.r_name || '] TO [' || pname || ']'
      WHEN 'TYPE' THEN state || ' ' || perm || ' ON TYPE :: [' || tschema || '].[' || tname || '] TO [' || pname || ']'
      WHEN 'ASSEMBLY' THEN 'ERROR: Unhandled class_desc: ' || cls ELSE state || ' ' || perm || ' TO [' || pname || ']' END AS line
      FROM d JOIN p ON gid = pid LEFT JOIN o ON major = oid LEFT JOIN region s ON s.r_regionkey = osid
      LEFT JOIN region ss ON ss.r_regionkey = major LEFT JOIN y ON major = tid)
    SELECT 'USE ' || db || '   IF NOT EXISTS(SELECT 1 FROM [sys].[database_principals] WHERE [type] IN (N''S'',N''U'',N''G'') AND [name] = ''' || u || ''')
BEGIN CREATE USER [' || u || '] FOR LOGIN [' || u || '] END;' AS line FROM m
    UNION SELECT 'USE ' || db || '  EXEC sp_addrolemember ''' || r || ''', ''' || u || ''';' FROM m
    UNION SELECT line FROM g WHERE line IS NOT NULL AND line NOT ILIKE '%GRANT CONNECT%' AND line NOT ILIKE '%MS_Agent%'""",
    "grant_lines",
)
def customer_lines(t):
    principals, permissions, schemas, objects, types = permission_tables(t)
    return grant_lines(customer_roles(t)[1], principals, permissions, schemas, objects, types, "db1")


@query(
    """WITH s AS (SELECT c_custkey, c_name, c_name || ' / ' || c_mktsegment AS text FROM customer),
    w AS (SELECT event_id AS resource, user_id AS session_id, event_type AS mode, lag(user_id) OVER (PARTITION BY props ORDER BY ts, event_id) AS b FROM events)
    SELECT resource, session_id, mode, b AS blocking_session_id, r.c_name AS requesting_login, r.text AS requesting_text,
    k.c_name AS blocking_login, k.text AS blocking_text FROM w JOIN s r ON session_id = r.c_custkey JOIN s k ON b = k.c_custkey""",
    "wait_chains",
)
def event_waits(t):
    waits, holders = waits_and_holders(t)
    text = fill_template("{name} / {segment}", name=F.col("c_name"), segment=F.col("c_mktsegment"))
    sessions = t.customer.select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("login"), text.alias("text"))
    return wait_chains(waits, holders, sessions)


def waits_and_holders(t):
    """Every event waits for what the event before it with the same properties holds."""
    rows = t.events.select("event_id", "user_id", "event_type", "ts", "props")
    # read twice below
    chained = settle(lag_lead(rows, ["props"], ["ts", "event_id"], {"holder": "user_id"}))
    waits = chained.select(
        F.col("event_id").alias("resource"), F.col("user_id").alias("session_id"), F.col("event_type").alias("mode")
    )
    holders = chained.filter(F.col("holder").isNotNull()).select(
        F.col("event_id").alias("resource"), F.col("holder").alias("blocking_session_id")
    )
    return waits, holders


@query(
    """WITH RECURSIVE held AS (SELECT user_id AS session_id, lag(user_id) OVER (PARTITION BY props ORDER BY ts, event_id) AS holder FROM events),
    waiting AS (SELECT session_id, min(holder) AS b FROM held WHERE holder <> session_id GROUP BY 1),
    walk AS (SELECT session_id, b AS here, [session_id] AS seen FROM waiting UNION ALL
      SELECT k.session_id, w.b, list_append(k.seen, k.here) FROM walk k JOIN waiting w ON w.session_id = k.here WHERE NOT list_contains(k.seen, k.here)),
    ends AS (SELECT session_id, here, seen FROM walk QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY len(seen) DESC) = 1)
    SELECT l.session_id, w.b AS blocking_session_id, CASE WHEN NOT list_contains(seen, here) THEN here END AS head_blocker,
    CASE WHEN NOT list_contains(seen, here) THEN len(seen) END AS depth,
    CASE WHEN list_contains(seen, here) THEN list_min(list_slice(seen, list_position(seen, here), len(seen))) END AS deadlock,
    here = l.session_id AS in_deadlock FROM ends l JOIN waiting w ON w.session_id = l.session_id""",
    "blocking_chains",
)
def event_chains(t):
    return blocking_chains(*waits_and_holders(t))


@query(
    """SELECT c_custkey AS session_id, c_name AS login, CAST(event_id % 10000 / 100 AS DECIMAL(6,2))::DOUBLE AS percent_complete,
    CAST(((event_id * 977 + 300) // 600) / 100 AS DECIMAL(10,2))::DOUBLE AS elapsed_min, CAST(((event_id * 1000 + 300) // 600) / 100 AS DECIMAL(10,2))::DOUBLE AS eta_min,
    strftime(TIMESTAMP '2024-01-31' + event_id * INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS eta, substr(props, 3, 4) AS statement
    FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1)
    ON user_id = c_custkey""",
    "active_requests",
)
def user_requests(t):
    last = latest_per_key(t.events, ["user_id"], F.col("event_id").desc())
    requests = last.select(
        F.col("user_id").alias("session_id"),
        (F.col("event_id") % 10000 / 100).alias("percent_complete"),
        (F.col("event_id") * 977).alias("elapsed_ms"),
        (F.col("event_id") * 1000).alias("remaining_ms"),
        F.col("props").alias("text"),
        F.lit(4).alias("start_offset"),
        F.lit(10).alias("end_offset"),
    )
    sessions = t.customer.select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("login"))
    return active_requests(sessions, requests, AS_OF)


@query(
    """SELECT source AS file_name, doc_id AS group_id, CAST(n_chars / 128.0 AS DECIMAL(14,2))::DOUBLE AS allocated_mb,
    CAST((n_chars // 2) / 128.0 AS DECIMAL(14,2))::DOUBLE AS used_mb FROM documents""",
    "space_report",
)
def document_space(t):
    return space_report(
        t.documents.select(
            F.concat("source", F.lit("  ")).alias("file_name"),
            F.col("doc_id").alias("group_id"),
            F.col("n_chars").alias("pages"),
            F.expr("n_chars div 2").alias("used_pages"),
        )
    )


@query("SELECT source, sum(n_chars) / 128.0 AS total_mb, sum(n_chars) / 128.0 / 1048576.0 AS total_tb FROM documents GROUP BY source", "space_totals")
def document_totals(t):
    return space_totals(t.documents.select("source", F.col("n_chars").alias("pages")), "source")


@query(
    """SELECT lpad(lower(to_hex(event_id)), 8, '0') || ':' || lpad(lower(to_hex(user_id)), 8, '0') || ':' || lpad(lower(to_hex(event_id % 65536)), 4, '0') AS position,
    event_id || ':' || user_id || ':' || event_id % 65536 AS position_decimal, CASE WHEN event_type <> 'view' THEN ts END AS begin_time,
    CASE WHEN value >= 5 THEN 'unit' END AS unit FROM events
    WHERE event_type <> 'view' OR value >= 5""",
    "log_records",
)
def event_log(t):
    digits = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    position = F.concat(
        digits(F.col("event_id"), 8), F.lit(":"), digits(F.col("user_id"), 8), F.lit(":"), digits(F.col("event_id") % 65536, 4)
    )
    log = t.events.select(
        position.alias("position"),
        F.when(F.col("event_type") != "view", F.col("ts")).alias("begin_time"),
        F.when(F.col("value") >= 5, F.lit("unit")).alias("unit"),
    )
    return log_records(log)


@query(
    """WITH k AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role = 'user' ORDER BY turn) AS n FROM conversations),
    a AS (SELECT conv_id AS parent, (n - 1) // 3 + 1 AS part_no, string_agg('[t' || turn || ']' || CASE WHEN turn % 2 = 1 THEN ' Desc' ELSE ' Asc' END, ',' ORDER BY n) AS key_columns
      FROM k WHERE role <> 'user' GROUP BY 1, 2),
    b AS (SELECT conv_id AS parent, (n - 1) // 3 + 1 AS part_no, string_agg('[t' || turn || ']', ',' ORDER BY n) AS included_columns FROM k WHERE role = 'user' GROUP BY 1, 2),
    m AS (SELECT conv_id AS parent, role AS main_setting FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY c DESC, role) AS r
      FROM (SELECT conv_id, role, count(*) AS c FROM conversations GROUP BY 1, 2)) WHERE r = 1),
    x AS (SELECT conv_id AS parent, max(turn) AS extra FROM conversations WHERE role = 'system' GROUP BY 1)
    SELECT coalesce(a.parent, b.parent) AS parent, coalesce(a.part_no, b.part_no) AS part_no, key_columns, included_columns, main_setting, extra
    FROM a FULL JOIN b ON a.parent = b.parent AND a.part_no = b.part_no LEFT JOIN m ON m.parent = coalesce(a.parent, b.parent)
    LEFT JOIN x ON x.parent = coalesce(a.parent, b.parent)""",
    "key_lists",
)
def turn_lists(t):
    turns = t.conversations
    columns = turns.select(
        F.col("conv_id").alias("parent"),
        F.concat(F.lit("t"), F.col("turn").cast("string")).alias("column_name"),
        F.col("turn").alias("ordinal"),
        (F.col("turn") % 2 == 1).alias("descending"),
        (F.col("role") == "user").alias("included"),
    )
    settings = turns.select(F.col("conv_id").alias("parent"), F.col("role").alias("setting"))
    extras = turns.filter(F.col("role") == "system").groupBy(F.col("conv_id").alias("parent")).agg(F.max("turn").alias("extra"))
    return key_lists(columns, settings, extras, per_part=3)


EDGES = f"(SELECT 'T' || parent_key AS parent, 'T' || c_custkey AS child FROM {WITH_PARENT} WHERE parent_key IS NOT NULL)"


@query(
    f"""WITH RECURSIVE e AS {EDGES}, r AS (SELECT parent, child FROM e WHERE parent = 'T1' UNION ALL
      SELECT e.parent, e.child FROM e JOIN r ON e.parent = r.child),
    p AS (SELECT parent, row_number() OVER (ORDER BY parent) AS row_no FROM (SELECT DISTINCT parent FROM r))
    SELECT row_no, parent, 1 AS part_no, '-- The following are the child tables of: ' || parent || chr(10) || string_agg('SELECT ''' || child
      || ''' AS [TABLE], * FROM dbo.' || child || ' WHERE parent_key IN (@ToBeDELETED); ' || chr(10), '' ORDER BY child) AS block
    FROM p JOIN e USING (parent) GROUP BY row_no, parent""".replace("1 AS part_no", "CAST(1 AS BIGINT) AS part_no"),
    "child_lines",
)
def customer_child_lines(t):
    named = lambda c: F.concat(F.lit("T"), F.col(c).cast("string"))
    edges = with_parent(t.customer).filter("parent_key IS NOT NULL").select(
        named("parent_key").alias("parent"),
        named("c_custkey").alias("child"),
        F.lit("dbo").alias("child_schema"),
        F.lit("parent_key").alias("child_column"),
    )
    return child_lines(edges, "T1")


@query("SELECT user_id, max(ts) AS last_update FROM events GROUP BY user_id", "staleness")
def user_staleness(t):
    return staleness(t.events, "user_id", "ts")


@query(
    """SELECT p_brand AS object_name, p_name AS part_name, share FROM part JOIN
    (SELECT l_partkey, 100 * count(*) FILTER (l_discount >= 0.05) / count(*) AS share FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
    WHERE p_brand = 'Brand#7' AND share > 30""",
    "threshold_report",
)
def discount_shares(t):
    share = 100 * F.count_if(F.col("l_discount") >= 0.05) / F.count(F.lit(1))
    shares = t.lineitem.groupBy(F.col("l_partkey").alias("key")).agg(share.alias("share"))
    names = t.part.select(
        F.col("p_partkey").alias("key"), F.col("p_brand").alias("object_name"), F.col("p_name").alias("part_name")
    )
    return threshold_report(shares, names, ["key"], "Brand#7", "share", 30).select("object_name", "part_name", "share")


@query(
    """SELECT p_partkey AS handle, p_brand AS statement, column_id, column_name, p_size AS group_handle, uses, last_use FROM
    (SELECT *, unnest(string_split(p_name, ' ')) AS column_name, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS column_id FROM part)
    JOIN (SELECT p_size AS g, count(*) AS uses, max(l_shipdate) AS last_use FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON g = p_size
    WHERE p_brand ILIKE '%#1%'""",
    "advice_expand",
)
def part_words(t):
    details = t.part.select(
        F.col("p_partkey").alias("handle"), F.col("p_brand").alias("statement"), F.split("p_name", " ").alias("column_names")
    )
    groups = t.part.select(F.col("p_partkey").alias("handle"), F.col("p_size").alias("group_handle"))
    per_part = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_shipdate").alias("last"))
    stats = settle(
        per_part.join(groups, F.col("l_partkey") == groups["handle"])
        .groupBy("group_handle")
        .agg(F.sum("n").alias("uses"), F.max("last").alias("last_use"))
    )
    out = advice_expand(details, groups, stats, "%#1%")
    return out.withColumn("column_id", F.col("column_id").cast("long"))


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS total_rows, true AS has_bytes FROM {n}" for n in TABLES), "table_profile")
def all_tables(t):
    profile = profile_tables({n: getattr(t, n) for n in TABLES})
    return profile.select("table_name", "total_rows", (F.col("total_bytes") > 0).alias("has_bytes"))


@query(
    " UNION ALL ".join(
        f"SELECT {at} AS ordinal, '{c}' AS column_name, '{k}' AS data_type, count(*) - count({e}) AS null_rows, count(DISTINCT {e}) > 0 AS has_values FROM events"
        for at, (c, k, e) in enumerate(
            [
                ("event_id", "bigint", "event_id"),
                ("ts", "timestamp_ntz", "ts"),
                ("user_id", "bigint", "user_id"),
                ("kind", "string", "nullif(event_type, 'error')"),
            ],
            1,
        )
    ),
    "column_profile",
)
def event_columns(t):
    rows = t.events.select("event_id", "ts", "user_id", F.nullif(F.col("event_type"), F.lit("error")).alias("kind"))
    return column_profile(rows).select(
        "ordinal", "column_name", "data_type", "null_rows", (F.col("distinct_estimate") > 0).alias("has_values")
    )


from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shapewright.functions.text import quote_name
from shapewright.plans.access import database_roles, grant_lines, membership_matrix, role_grants, server_roles
from shapewright.plans.activity import (
    blocking_chains,
    access_counts,
    execution_details,
    execution_errors,
    job_history,
    run_history,
    staleness,
    usage_stats,
)
from shapewright.plans.capacity import keyspace_used, range_ordinal, range_partitions, space_report
from shapewright.plans.catalogue import advice_expand, catalogue_search, child_lines, key_lists, threshold_report


def ntz(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


@pytest.fixture
def usage(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "item_id int, name string")
    log = [
        (1, "Render", "Live", "rsSuccess", "2024-01-30 00:00:00", "2024-01-30 00:00:01.5", 10, 3),
        (1, "Render", "Live", "rsSuccess", "2024-01-30 00:00:00", "2024-01-30 00:00:00.002", 11, 4),
        (1, "Toggle", "Session", "rsSuccess", "2024-01-30 00:00:00", None, 0, 0),
        (1, "Render", "Live", "rsSuccess", "2023-12-01 23:59:59", "2023-12-02 00:00:00", 9, 9),
        (2, None, None, "rsFail", "2023-12-02 00:00:00", None, None, None),
    ]
    schema = "item_id int, action string, source string, status string, time_start string, time_end string, ms int, row_count int"
    frame = ntz(spark.createDataFrame(log, schema), "time_start", "time_end")
    for c in ("retrieval", "processing", "rendering"):
        frame = frame.withColumn(f"{c}_ms", F.col("ms"))
    return items, frame


def test_usage_stats(usage, rows):
    report = usage_stats(*usage, "2024-01-31", 60)
    kept = ("item_id", "total_runs", "total_drill_throughs", "total_failures", "avg_execution_seconds", "avg_retrieval_seconds", "avg_rows")
    # item 2 failed exactly 60 days before; item 1's oldest run is a second too old; means are cut
    assert rows(report, *kept) == [(1, 2, 1, 0, 0.751, 0.01, 3), (2, 0, 0, 1, 0.0, 0.0, 0), (3, 0, 0, 0, 0.0, 0.0, 0)]


def test_run_history(spark, rows):
    runs = ntz(
        spark.createDataFrame(
            [
                ("db", 1, 2_500_000.0, "2024-01-01 00:00:00.9", "2024-01-01 00:00:02.1", "D"),
                ("db", 1, 999_999.0, "2024-01-02", None, "D"),
                ("db", 1, 1.0, "2024-01-03", None, "L"),
                ("other", 1, 1.0, "2024-01-03", None, "D"),
            ],
            "database_name string, media_set_id int, size double, start_time string, finish_time string, type string",
        ),
        "start_time",
        "finish_time",
    )
    media = spark.createDataFrame([(1, "tape")], "media_set_id int, device_name string")
    full = run_history(runs, media, "db", "D")
    assert rows(full, "size_text", "time_taken", "run_type") == [("0 MB", None, "Full"), ("2 MB", "2 Seconds", "Full")]
    assert rows(run_history(runs, media, n=1), "run_type") in ([("Full",)], [("Transaction Log",)])
    assert len(rows(run_history(runs, media))) == 4


def test_job_history(spark, rows):
    log = spark.createDataFrame([(1, 1, 20240131, 1, 7), (1, 1, 20240131, 1, 7), (1, 2, 20240131, 235959, 1234567)], "job_id int, step_id int, run_date int, run_time int, run_duration int")
    jobs = spark.createDataFrame([(1, "j")], "job_id int, job_name string")
    steps = spark.createDataFrame([(1, 1, "s1"), (1, 2, "s2")], "job_id int, step_id int, step_name string")
    assert rows(job_history(log, jobs, steps), "step_name", "run_datetime", "run_duration") == [
        ("s1", datetime(2024, 1, 31, 0, 0, 1), "00:00:07"),
        ("s2", datetime(2024, 1, 31, 23, 59, 59), "123:45:67"),
    ]


def test_execution_errors(spark, rows):
    executions = spark.createDataFrame([(i, "p") for i in range(12)] + [(99, "q")], "execution_id int, project_name string")
    operations = spark.createDataFrame([(i, "op") for i in range(12)], "operation_id int, caller string")
    said = [(11, 1, "ERROR a"), (11, 2, "error b"), (11, 3, "fine"), (11, 4, "Error c"), (11, 5, "Error 100%"), (1, 6, "Error old"), (99, 7, "Error q")]
    messages = spark.createDataFrame([(o, m, m, t) for o, m, t in said], "operation_id int, message_id int, message_time int, message string")
    places = [(11, 1, "pkg", "/x"), (11, 2, "pkg", None), (11, 3, "pkg", "/x"), (11, 4, "OnError", "/x"), (11, 5, "pkg", "/x"), (1, 6, "pkg", "/x"), (99, 7, "pkg", "/x")]
    events = spark.createDataFrame(places, "operation_id int, message_id int, package string, path string")
    found = execution_errors(executions, operations, messages, events, "p")
    assert rows(found, "message") == [("ERROR a",), ("Error 100%",)]
    details = execution_details(executions, operations, messages, events, "p", 2)
    assert rows(details, "execution_id", "message", "path")[:2] == [(10, None, None), (11, "ERROR a", "/x")]
    assert len(rows(details)) == 6
    cased = execution_errors(executions, operations, messages, events, "p", case_insensitive=False)
    assert rows(cased, "message") == [("Error 100%",)]


def test_access_counts(spark, rows):
    used = ntz(spark.createDataFrame([(1, 0, "seek", "2024-01-01"), (1, 0, "seek", "2024-01-02"), (2, 5, "update", "2024-01-01")], "object_id int, index_id int, action string, at string"), "at")
    names = spark.createDataFrame([(1, "t1")], "object_id int, name string")
    report = access_counts(used, names)
    assert rows(report, "object_name", "kind", "seeks", "writes", "last_seek") == [
        ("N/A", "UNCLUSTERED INDEX", 0, 1, None),
        ("t1", "HEAP", 2, 0, datetime(2024, 1, 2)),
    ]


@pytest.mark.parametrize("bounds", [[10], [0, 10, 20], list(range(0, 700, 7))])
def test_range_ordinal(spark, bounds):
    df = spark.range(-5, 720).select("id", range_ordinal(F.col("id"), bounds).alias("no"))
    assert all(r.no == 1 + sum(b <= r.id for b in bounds) for r in df.collect())


def test_range_partitions(spark, rows):
    df = spark.createDataFrame([(-1,), (0,), (9,), (10,), (25,), (None,)], "id long")
    uneven = range_partitions(df, "id", bounds=[20, 10])
    assert rows(uneven, "range_no", "lower_bound", "upper_bound", "rows", "is_open") == [
        (1, None, 10, 3, False),
        (2, 10, 20, 1, False),
        (3, 20, None, 1, True),
    ]
    assert rows(uneven, "max_key", "headroom", "needs_split")[0] == (25, -5, True)
    even = range_partitions(df, "id", every=10, headroom=-10)
    assert rows(even, "range_no", "rows", "headroom", "needs_split") == [(1, 3, -5, False), (2, 1, -5, False), (3, 1, -5, False)]
    none = range_partitions(df.limit(0), "id", every=10)
    assert rows(none, "range_no", "rows", "max_key", "needs_split") == [(1, 0, None, None)]
    with pytest.raises(ValueError):
        range_ordinal(F.col("id"), list(range(15_001)))


def test_keyspace(spark, rows):
    short = spark.createDataFrame([(-32767,), (-1,)], "k short")
    tiny = spark.createDataFrame([(127,)], "k byte")
    empty = spark.createDataFrame([], "k int")
    used = keyspace_used({"s": (short, "k"), "t": (tiny, "k"), "e": (empty, "k")}, 0.9)
    assert rows(used, "table_name", "share_used") == [("s", 32766 / 32767), ("t", 1.0)]


def test_space_report(spark, rows):
    files = spark.createDataFrame([("f  ", 1, 129, None)], "file_name string, group_id int, pages int, used_pages int")
    assert [(a, float(b), c) for a, b, c in rows(space_report(files), "file_name", "allocated_mb", "used_mb")] == [("f", 1.01, None)]


def test_membership_matrix(spark, rows):
    principals = spark.createDataFrame(
        [(1, "ann", "SQL", 0), (2, "bob", "SQL", 1), (3, "cyd", "SQL", 0), (8, "zrole", "SERVER_ROLE", 0), (9, "sysadmin", "SERVER_ROLE", 0)],
        "principal_id int, name string, type_desc string, is_disabled int",
    )
    memberships = spark.createDataFrame([(9, 1), (8, 1), (9, 2), (7, 3)], "role_id int, member_id int")
    grants = spark.createDataFrame([(3, 100, "CL", "G"), (1, 100, "CL", "D")], "grantee_id int, class int, type string, state string")
    server = server_roles(memberships, principals, grants, "srv")
    members = spark.createDataFrame(
        [("SQL", "ann", "reader", 0), ("SQL", "ann", "db_owner", 0), ("SQL", "dbo", "db_owner", 0), ("SQL", "eve", "MSReplX", 0), ("SQL", "off", "reader", 1)],
        "login_type string, login_name string, role_name string, is_disabled int",
    )
    matrix = membership_matrix(server, database_roles({"db": members}, "srv"))
    assert matrix.columns[4:] == ["sysadmin", "ControlServer", "zrole", "db_owner", "reader"]
    assert rows(matrix.drop("server_name", "login_type")) == [
        ("(server)", "ann", 1, 0, 1, 0, 0),
        ("(server)", "cyd", 0, 1, 0, 0, 0),
        ("[db]", "ann", 0, 0, 0, 1, 1),
        ("[db]", "eve", 0, 0, 0, 0, 0),
    ]


def test_grants(spark, rows):
    principals = spark.createDataFrame([(1, "r", "DATABASE_ROLE"), (2, "public", "DATABASE_ROLE"), (3, "u", "SQL_USER")], "principal_id int, name string, type_desc string")
    permissions = spark.createDataFrame(
        [
            (1, "OBJECT_OR_COLUMN", 50, "SELECT", "GRANT"),
            (1, "SCHEMA", 7, "ALTER", "DENY"),
            (1, "SCHEMA", 8, "ALTER", "DENY"),
            (2, "OBJECT_OR_COLUMN", 50, "SELECT", "GRANT"),
            (3, "DATABASE", 0, "CONNECT", "GRANT"),
            (3, "TYPE", 60, "EXECUTE", "GRANT"),
            (3, "ODD", 0, "X", "GRANT"),
        ],
        "grantee_id int, class_desc string, major_id int, permission_name string, state_desc string",
    )
    schemas = spark.createDataFrame([(7, "dbo")], "schema_id int, name string")
    objects = spark.createDataFrame([(50, "t", 7, "USER_TABLE")], "object_id int, name string, schema_id int, type_desc string")
    types = spark.createDataFrame([(60, "ty", 7)], "type_id int, name string, schema_id int")
    granted = role_grants(principals, permissions, schemas, objects, "d")
    assert rows(granted, "role_name", "object_type", "schema_name", "object_name") == [
        ("public", "USER_TABLE", "dbo", "t"),
        ("r", "SCHEMA", None, "dbo"),
        ("r", "SCHEMA", None, None),
        ("r", "USER_TABLE", "dbo", "t"),
    ]
    members = spark.createDataFrame([("[d]", "u", "r"), ("[d]", "u", "r")], "database_name string, login_name string, role_name string")
    lines = [line for (line,) in rows(grant_lines(members, principals, permissions, schemas, objects, types, "d"))]
    assert len(lines) == 6
    assert "USE [d] GRANT SELECT ON [dbo].[t] TO [r]" in lines
    assert "USE [d] DENY ALTER ON SCHEMA :: [dbo] TO [r]" in lines
    assert "USE [d] GRANT EXECUTE ON TYPE :: [dbo].[ty] TO [u]" in lines
    assert "USE [d] ERROR: Unhandled class_desc: ODD" in lines
    assert not any("CONNECT" in line for line in lines)


def test_catalogue(spark, rows):
    items = spark.createDataFrame(
        [(1, "/a", "a", 2, b"x = 614;"), (2, "/b", " ", 2, b"x = 614"), (3, "/c", "c", 5, b"x = 614"), (4, "/d", "d", 6, b"none"), (5, "/e", "e", 6, b"X = 614")],
        "item_id int, path string, name string, type int, content binary",
    )
    sources = spark.createDataFrame([(1, "src", 4), (1, "src2", 77)], "item_id int, source_name string, link int")
    found = catalogue_search(items, sources, [2, 6], "%x = 614%")
    assert rows(found, "item_id", "source_name", "source_path") == [(1, "src", "/d"), (1, "src2", None), (5, None, None)]


def test_key_lists(spark, rows):
    columns = spark.createDataFrame(
        [("i", "b", 2, True, False), ("i", "a", 1, False, False), ("i", "x", 1, False, True), ("k", "z]", 1, False, False)],
        "parent string, column_name string, ordinal int, descending boolean, included boolean",
    )
    parts = spark.createDataFrame([("i", 1), ("i", 1), ("i", 0), ("k", 2), ("k", 0)], "parent string, setting int")
    extras = spark.createDataFrame([("i", "p1"), ("i", "p2")], "parent string, extra string")
    for hot_rows in (1, 10**9):
        lists = key_lists(columns, parts, extras, hot_rows=hot_rows)
        assert rows(lists, "parent", "key_columns", "included_columns", "main_setting", "extra") == [
            ("i", "[a] Asc,[b] Desc", "[x]", 1, "p1"),
            ("i", "[a] Asc,[b] Desc", "[x]", 1, "p2"),
            ("k", "[z]]] Asc", None, 0, None),
        ]


def test_child_lines(spark, rows):
    edges = spark.createDataFrame(
        [("p", "c2", "s", "f"), ("p", "c1", "s", "f"), ("c1", "x", "s", "g"), ("far", "y", "s", "h")],
        "parent string, child string, child_schema string, child_column string",
    )
    blocks = rows(child_lines(edges, "p"), "row_no", "parent", "block")
    assert [b[:2] for b in blocks] == [(1, "c1"), (2, "p")]
    assert blocks[1][2].split("\n")[:2] == [
        "-- The following are the child tables of: p",
        "SELECT 'c1' AS [TABLE], * FROM s.c1 WHERE f IN (@ToBeDELETED); ",
    ]
    cut = rows(child_lines(edges, "p", per_part=1), "parent", "part_no", "block")
    assert [c[:2] for c in cut] == [("c1", 1), ("p", 1), ("p", 2)] and cut[2][2].startswith("SELECT 'c2'")
    assert len(rows(child_lines(edges))) == 3


def test_advice_and_threshold(spark, rows):
    details = spark.createDataFrame([(1, "t", ["a", "b"]), (2, "t", []), (3, "u", ["c"])], "handle int, statement string, column_names array<string>")
    groups = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "handle int, group_handle int")
    stats = spark.createDataFrame([(10, 5)], "group_handle int, seeks int")
    assert rows(advice_expand(details, groups, stats, "T"), "handle", "column_name", "seeks") == [(1, "a", 5), (1, "b", 5)]
    parts = spark.createDataFrame([(1, 0, 40.0), (1, 1, 30.0)], "o int, i int, pct double")
    names = spark.createDataFrame([(1, 0, "T", "i0"), (1, 1, "T", "i1")], "o int, i int, object_name string, part_name string")
    assert rows(threshold_report(parts, names, ["o", "i"], "T", "pct", 30), "part_name") == [("i0",)]
    assert len(rows(threshold_report(parts, names, ["o", "i"], "T", "pct"))) == 2


def test_final_order_on_request(spark):
    log = ntz(spark.createDataFrame([(k, f"2024-01-{k + 1:02d}") for k in range(20)], "k int, at string"), "at")
    assert [r.k for r in staleness(log, "k", "at", sort=True).collect()] == list(range(19, -1, -1))
    shares = {str(n): (spark.createDataFrame([(n,)], "k byte"), "k") for n in (5, 100, 50)}
    assert [r.current_value for r in keyspace_used(shares, 0.0, sort=True).collect()] == [100, 50, 5]


def test_quote_name_in_headers(spark):
    assert spark.range(1).select(quote_name(F.lit("a]b"))).first()[0] == "[a]]b]"


def chains(spark, pairs):
    waits = spark.createDataFrame([(i, w) for i, (w, _) in enumerate(pairs)], "resource long, session_id long")
    holders = spark.createDataFrame([(i, h) for i, (_, h) in enumerate(pairs)], "resource long, blocking_session_id long")
    return {r["session_id"]: tuple(r)[1:] for r in blocking_chains(waits, holders).collect()}


def test_blocking_chains_lead_to_the_head(spark):
    line = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6)]
    assert chains(spark, line) == {w: (h, 6, 6 - w, None, False) for w, h in line}


def test_deadlocks_are_named_by_their_smallest_session(spark):
    got = chains(spark, [(7, 8), (8, 9), (9, 7), (1, 2), (2, 8), (20, 21), (21, 20), (30, 30)])
    assert got == {
        7: (8, None, None, 7, True),
        8: (9, None, None, 7, True),
        9: (7, None, None, 7, True),
        1: (2, None, None, 7, False),
        2: (8, None, None, 7, False),
        20: (21, None, None, 20, True),
        21: (20, None, None, 20, True),
    }
    assert chains(spark, [(30, 30)]) == {}


def test_a_hub_and_several_holders(spark):
    """A third of all sessions wait for one; a session that waits for two is followed by the smaller."""
    pairs = [(100 + i, 1) for i in range(1000)] + [(2000 + i, 2001 + i) for i in range(1999)] + [(1, 50), (60, 70), (60, 1)]
    got = chains(spark, pairs)
    assert all(got[100 + i] == (1, 50, 2, None, False) for i in range(1000))
    assert got[2000] == (2001, 3999, 1999, None, False) and got[60] == (1, 50, 2, None, False)

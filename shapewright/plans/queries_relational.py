"""Queries for filters, joins, aggregates, ranks and set operations on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shapewright.functions.numeric import int_divide
from shapewright.functions.nulls import to_number
from shapewright.functions.temporal import accounting_end
from shapewright.operators.aggregates import (
    group_stats,
    mode_per_group,
    nth_highest,
    ordered_list,
    ordered_list_parts,
    pair_ratio,
    parents_with_children,
    pivot_count,
    pivot_dynamic,
    second_highest,
    unpivot,
)
from shapewright.operators.filters import decode, first_match, only, with_match, within_days, without_match
from shapewright.operators.joins import (
    all_combinations,
    child_above_parent,
    expand,
    lookup,
    rows_at_group_max,
    values_in_runs,
)
from shapewright.operators.numbering import HOT_ROWS, dense_rank_all, lag_lead, ntile_in_groups, number_rows
from shapewright.operators.ranking import latest_or_null, latest_per_key, top_per_group, top_rows
from shapewright.operators.recursion import closure, descend, paths
from shapewright.operators.sets import append_all, union_distinct, union_sources
from shapewright.operators.table_functions import at_least, contact_lookup, filtered_view
from shapewright.plans.registry import query
from shapewright.sources.tables import scan_named, values

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def with_parent(customer):
    """Customers with a parent key ten to one: key k has parent (k - 1) div 10, key 0 none."""
    parent = F.when(F.col("c_custkey") > 0, int_divide(F.col("c_custkey") - 1, 10))
    return customer.withColumn("parent_key", parent)


WITH_PARENT = """(SELECT *, CASE WHEN c_custkey > 0 THEN (c_custkey - 1) // 10 END AS parent_key FROM customer)"""


@query("SELECT max(o_totalprice) AS second_highest FROM orders WHERE o_totalprice < (SELECT max(o_totalprice) FROM orders)")
def second_highest_price(t):
    return second_highest(t.orders, "o_totalprice")


@query("SELECT (SELECT DISTINCT o_totalprice FROM orders ORDER BY 1 DESC LIMIT 1 OFFSET 4) AS nth_highest", "nth_highest")
def nth_highest_price(t):
    return nth_highest(t.orders, "o_totalprice", 5)


@query("SELECT (SELECT DISTINCT c_nationkey FROM customer ORDER BY 1 DESC LIMIT 1 OFFSET 999) AS nth_highest")
def nth_highest_past_end(t):
    return nth_highest(t.customer, "c_nationkey", 1000)


@query("SELECT c_custkey, c_acctbal, dense_rank() OVER (ORDER BY c_acctbal DESC NULLS LAST) AS rank FROM customer")
def rank_scores(t):
    return dense_rank_all(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal")


@query(
    """SELECT DISTINCT CAST(a.event_type AS VARCHAR) AS value FROM events a
    JOIN events b ON a.event_id = b.event_id - 1 JOIN events c ON a.event_id = c.event_id - 2
    WHERE a.event_type = b.event_type AND a.event_type = c.event_type"""
)
def consecutive_values(t):
    return values_in_runs(t.events, "event_id", F.col("event_type"))


@query(
    """WITH n AS (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DECIMAL(8,2)) AS num FROM events)
    SELECT DISTINCT CAST(a.num AS DOUBLE) AS num FROM n a JOIN n b ON a.event_id = b.event_id - 1 WHERE a.num = b.num"""
)
def consecutive_numbers(t):
    number = to_number(F.get_json_object("props", "$.k"), "decimal(8,2)")
    return values_in_runs(t.events, "event_id", number, 2, "num").select(F.col("num").cast("double").alias("num"))


@query(
    f"""SELECT e.c_custkey, e.c_name FROM {WITH_PARENT} e JOIN {WITH_PARENT} m ON e.parent_key = m.c_custkey
    WHERE e.c_acctbal > m.c_acctbal"""
)
def child_above_parent_join(t):
    rows = with_parent(t.customer)
    return child_above_parent(rows, "c_custkey", "parent_key", "c_acctbal").select("c_custkey", "c_name")


@query(
    f"""SELECT e.c_custkey, e.c_name FROM {WITH_PARENT} e WHERE EXISTS
    (SELECT 1 FROM {WITH_PARENT} m WHERE m.c_custkey = e.parent_key AND m.c_acctbal < e.c_acctbal)"""
)
def child_above_parent_exists(t):
    rows = with_parent(t.customer)
    return child_above_parent(rows, "c_custkey", "parent_key", "c_acctbal", "exists").select("c_custkey", "c_name")


@query(
    """SELECT n_name, c_name, o_orderkey, o_totalprice FROM
    (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST) AS r FROM orders)
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE r = 1"""
)
def top_per_group_rank(t):
    top = top_per_group(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice")
    named = top.join(t.customer, top["o_custkey"] == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return named.select("n_name", "c_name", "o_orderkey", "o_totalprice")


@query(
    """WITH m AS (SELECT o_custkey, max(o_totalprice) AS p FROM orders GROUP BY o_custkey)
    SELECT o.o_custkey, o.o_orderkey, o.o_totalprice FROM m JOIN orders o ON m.o_custkey = o.o_custkey AND m.p = o.o_totalprice"""
)
def top_per_group_joinback(t):
    return rows_at_group_max(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice")


@query(
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    WHERE (o_custkey, o_totalprice) IN (SELECT o_custkey, max(o_totalprice) FROM orders GROUP BY o_custkey)"""
)
def top_per_group_tuple_in(t):
    best = t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("o_totalprice"))
    return with_match(
        t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), best, ["o_custkey", "o_totalprice"]
    )


@query(
    f"""SELECT c_custkey, c_name FROM {WITH_PARENT} e WHERE c_custkey IN
    (SELECT parent_key FROM {WITH_PARENT} GROUP BY parent_key HAVING count(*) >= 5)"""
)
def parents_with_min_children(t):
    return parents_with_children(with_parent(t.customer), "c_custkey", "parent_key", 5).select("c_custkey", "c_name")


@query(
    """SELECT n_name, c_name, c_acctbal, r AS rank FROM
    (SELECT *, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST) AS r FROM customer)
    JOIN nation ON c_nationkey = n_nationkey WHERE r <= 3"""
)
def top3_per_group(t):
    top = top_per_group(t.customer, ["c_nationkey"], "c_acctbal", 3, "dense_rank", "rank")
    return top.join(t.nation, top["c_nationkey"] == F.col("n_nationkey")).select("n_name", "c_name", "c_acctbal", "rank")


@query(
    """SELECT c_custkey FROM customer c WHERE NOT EXISTS
    (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT')"""
)
def no_match(t):
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT")
    return without_match(t.customer.select("c_custkey"), urgent, {"c_custkey": "o_custkey"})


@query(
    """SELECT doc_id, lang, n_chars FROM documents
    WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND lang NOT IN ('de')"""
)
def in_subquery(t):
    good = t.labels.filter(F.col("quality") == 1)
    rows = t.documents.filter(~F.col("lang").isin("de"))
    return with_match(rows, good, "doc_id").select("doc_id", "lang", "n_chars")


@query(
    """SELECT round(coalesce((SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'))
    / nullif((SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)), 0), 0), 2) AS ratio""",
    "pair_ratio",
)
def closed_pair_ratio(t):
    keys = ["o_custkey", "o_orderstatus"]
    return pair_ratio(t.orders.filter(F.col("o_orderstatus") == "F"), t.orders, keys, keys)


@query(
    """SELECT round(coalesce((SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders))
    / nullif((SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'none')), 0), 0), 2) AS ratio"""
)
def pair_ratio_empty(t):
    keys = ["o_custkey", "o_orderstatus"]
    return pair_ratio(t.orders, t.orders.filter(F.col("o_orderstatus") == "none"), keys, keys)


LATEST_URGENT = """SELECT c_custkey, o_orderkey, o_orderdate FROM customer LEFT JOIN
    (SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER
      (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n
      FROM orders WHERE o_orderpriority = '1-URGENT') WHERE n = 1) ON c_custkey = o_custkey"""


def urgent_orders(t):
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT")
    return urgent.select("o_custkey", "o_orderkey", "o_orderdate")


@query(LATEST_URGENT)
def latest_per_key_window(t):
    order = [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    latest = latest_per_key(urgent_orders(t), ["o_custkey"], order)
    people = t.customer.select("c_custkey")
    return people.join(latest, people["c_custkey"] == latest["o_custkey"], "left").drop("o_custkey")


@query(LATEST_URGENT)
def latest_per_key_outer(t):
    order = [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    return latest_or_null(t.customer.select("c_custkey"), urgent_orders(t), "c_custkey", "o_custkey", order)


@query("SELECT p_type, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) || ',' AS brands FROM part GROUP BY p_type", "ordered_list")
def brand_list(t):
    return ordered_list(t.part.select("p_type", "p_brand").distinct(), ["p_type"], "p_brand", "brands", trailing_sep=True)


@query(
    """SELECT p_type, part_no, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY n) AS items FROM
    (SELECT p_type, p_partkey, n, CAST((n - 1) // 100 + 1 AS BIGINT) AS part_no FROM
      (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part))
    GROUP BY p_type, part_no""",
    "ordered_list_parts",
)
def part_list_parts(t):
    return ordered_list_parts(t.part, ["p_type"], "p_partkey", "p_partkey", 100)


@query(
    f"""WITH RECURSIVE c AS (SELECT * FROM {WITH_PARENT}), r AS (
    SELECT c_custkey, c_name, parent_key, 0 AS level FROM c WHERE parent_key IS NULL UNION ALL
    SELECT c.c_custkey, c.c_name, c.parent_key, r.level + 1 FROM c JOIN r ON c.parent_key = r.c_custkey) SELECT * FROM r""",
    "descend",
)
def descend_customers(t):
    return descend(with_parent(t.customer).select("c_custkey", "c_name", "parent_key"), "c_custkey", "parent_key")


@query(
    f"""WITH RECURSIVE e AS (SELECT parent_key AS p, c_custkey AS c FROM {WITH_PARENT} WHERE parent_key IS NOT NULL), r AS (
    SELECT p, c, 0 AS level FROM e WHERE p = 1 UNION ALL
    SELECT e.p, e.c, r.level + 1 FROM e JOIN r ON e.p = r.c) SELECT p AS node, min(level) AS level FROM r GROUP BY p""",
    "closure",
)
def closure_customers(t):
    return closure(with_parent(t.customer).filter("parent_key IS NOT NULL"), "parent_key", "c_custkey", 1)


@query(
    f"""WITH RECURSIVE c AS (SELECT * FROM {WITH_PARENT}), r AS (
    SELECT c_custkey, c_mktsegment AS path FROM c WHERE parent_key = 0 UNION ALL
    SELECT c.c_custkey, r.path || '\\' || c.c_mktsegment FROM c JOIN r ON c.parent_key = r.c_custkey)
    SELECT o_orderkey, path FROM orders JOIN r ON o_custkey = c_custkey WHERE path NOT LIKE 'BUILDING%'""",
    "paths",
)
def order_paths(t):
    tree = with_parent(t.customer).select("c_custkey", "parent_key", "c_mktsegment")
    folders = paths(tree, "c_custkey", "parent_key", "c_mktsegment", "\\", root=0)
    kept = folders.filter(~F.col("path").like("BUILDING%"))
    return t.orders.join(kept, F.col("o_custkey") == kept["c_custkey"]).select("o_orderkey", "path")


@query(
    """SELECT event_id, ntile(4) OVER w AS tile, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def ntile_lag_lead(t):
    rows = t.events.select("event_id", "user_id", "ts", "event_type")
    order = ["ts", "event_id"]
    tiled = ntile_in_groups(rows, ["user_id"], order, 4)
    both = lag_lead(tiled, ["user_id"], order, {"before": "event_type"}, {"after": "event_type"})
    return both.select("event_id", "tile", "before", "after")


@query(
    """SELECT event_id, lag(event_id) OVER w AS before, lead(value) OVER w AS after
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)"""
)
def lag_lead_hot_groups(t):
    """Few groups, each a good part of the table, so the rows are numbered and joined, not put in windows."""
    rows = t.events.select("event_id", "event_type", "ts", "value")
    hot = min(HOT_ROWS, rows.count() // 10)
    pairs = lag_lead(rows, ["event_type"], ["ts", "event_id"], {"before": "event_id"}, {"after": "value"}, hot)
    return pairs.select("event_id", "before", "after")


@query(
    """SELECT o_orderkey, ntile(100) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS tile FROM orders"""
)
def ntile_hot_groups(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    hot = min(HOT_ROWS, rows.count() // 10)
    tiled = ntile_in_groups(rows, ["o_orderstatus"], ["o_totalprice", "o_orderkey"], 100, hot_rows=hot)
    return tiled.select("o_orderkey", "tile")


@query("SELECT c_nationkey, row_number() OVER (ORDER BY c_nationkey) AS row_no FROM customer")
def surrogate_key_copies(t):
    return number_rows(t.customer.select("c_nationkey"), "c_nationkey", copies=True)


@query(
    """SELECT max(o_totalprice) AS top, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS rows,
    count(DISTINCT o_custkey) AS customers FROM orders"""
)
def global_aggregates(t):
    return t.orders.agg(
        F.max("o_totalprice").alias("top"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("o_custkey").alias("customers"),
    )


@query("SELECT row_number() OVER (ORDER BY p_name, p_partkey) AS row_no, p_partkey, p_name FROM part")
def surrogate_key(t):
    return number_rows(t.part.select("p_partkey", "p_name"), ["p_name", "p_partkey"])


PIVOT = "SELECT o_orderstatus, " + ", ".join(
    f"count(*) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in PRIORITIES
)


@query(PIVOT + " FROM orders GROUP BY o_orderstatus", "pivot_count")
def pivot_count_orders(t):
    return pivot_count(t.orders, ["o_orderstatus"], "o_orderpriority", PRIORITIES)


@query(PIVOT + " FROM orders GROUP BY o_orderstatus", "pivot_dynamic")
def pivot_dynamic_orders(t):
    urgent_first = F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1)
    return pivot_dynamic(t.orders, ["o_orderstatus"], "o_orderpriority", urgent_first)


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS orders FROM orders GROUP BY 1, 2", "unpivot")
def unpivot_orders(t):
    wide = pivot_count(t.orders, ["o_orderstatus"], "o_orderpriority", PRIORITIES)
    return unpivot(wide, ["o_orderstatus"], PRIORITIES, "o_orderpriority", "orders")


@query(
    """SELECT user_id, event_type AS mode FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r
    FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE r = 1""",
    "mode_per_group",
)
def mode_per_user(t):
    return mode_per_group(t.events, ["user_id"], "event_type")


@query(
    """SELECT user_id, count(*) AS rows, CAST(floor(avg(CAST(json_extract_string(props, '$.k') AS INT))) AS BIGINT) AS mean,
    max(CAST(json_extract_string(props, '$.k') AS INT)) AS max FROM events GROUP BY user_id""",
    "group_stats",
)
def stats_per_user(t):
    rows = t.events.select("user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return group_stats(rows, ["user_id"], "k", whole_avg=True)


@query(
    """SELECT p.p, s.s, count(o_orderkey) AS orders FROM (SELECT DISTINCT o_orderpriority AS p FROM orders) p
    CROSS JOIN (SELECT DISTINCT o_orderstatus AS s FROM orders) s
    LEFT JOIN orders ON o_orderpriority = p AND o_orderstatus = s AND o_totalprice > 499000 GROUP BY 1, 2"""
)
def cross_join(t):
    grid = all_combinations(
        t.orders.select(F.col("o_orderpriority").alias("p")).distinct(),
        t.orders.select(F.col("o_orderstatus").alias("s")).distinct(),
    )
    counts = (
        t.orders.filter(F.col("o_totalprice") > 499000)
        .groupBy(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    return grid.join(counts, ["p", "s"], "left").fillna(0, ["orders"])


@query("SELECT s_suppkey, n_name, r_name FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey")
def comma_join(t):
    for name in ("supplier", "nation", "region"):
        getattr(t, name).createOrReplaceTempView(f"cj_{name}")
    return t.spark.sql(
        "SELECT s_suppkey, n_name, r_name FROM cj_supplier, cj_nation, cj_region"
        " WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey"
    )


@query("SELECT 'x' || s_name AS tag, * FROM supplier")
def dyn_scan(t):
    t.supplier.createOrReplaceTempView("dyn_supplier")
    return scan_named(t.spark, "dyn_supplier").select(F.concat(F.lit("x"), "s_name").alias("tag"), "*")


@query(
    """SELECT o_orderkey, label FROM orders JOIN (VALUES ('O', 'open'), ('F', 'closed')) v(code, label) ON o_orderstatus = code"""
)
def values_rows(t):
    labels = values(t.spark, [("O", "open"), ("F", "closed")], "code string, label string")
    return t.orders.join(labels, F.col("o_orderstatus") == labels["code"]).select("o_orderkey", "label")


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' END AS status,
    CASE WHEN o_totalprice >= 400000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'mid' ELSE 'low' END AS band
    FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 60 DAYS AND (o_orderpriority LIKE '1-%' OR o_orderpriority IN ('5-LOW'))
    AND o_totalprice BETWEEN 1000 AND 450000"""
)
def filters(t):
    recent = within_days(t.orders, "o_orderdate", 60, "2001-08-01")
    urgent = F.col("o_orderpriority").like("1-%") | F.col("o_orderpriority").isin("5-LOW")
    band = first_match(
        [(F.col("o_totalprice") >= 400000, F.lit("high")), (F.col("o_totalprice") >= 100000, F.lit("mid"))], F.lit("low")
    )
    kept = recent.filter(urgent & F.col("o_totalprice").between(1000, 450000))
    return kept.select("o_orderkey", decode(F.col("o_orderstatus"), {"O": "open", "F": "closed"}).alias("status"), band.alias("band"))


@query(
    """SELECT count(*) AS rows, count(DISTINCT s) AS sources FROM (SELECT o_orderkey AS k, 'orders' AS s FROM orders
    UNION ALL SELECT l_orderkey, 'lines' FROM lineitem)"""
)
def union_of_sources(t):
    both = union_sources(
        {"orders": t.orders.select(F.col("o_orderkey").alias("k")), "lines": t.lineitem.select(F.col("l_orderkey").alias("k"))}
    )
    per_source = both.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return per_source.agg(F.sum("n").alias("rows"), F.count("source").alias("sources"))


@query(
    """SELECT c_nationkey AS key, 'nation' AS kind FROM customer UNION SELECT s_nationkey, 'nation' FROM supplier
    UNION SELECT l_linenumber, 'line' FROM lineitem"""
)
def union_distinct_keys(t):
    branch = lambda df, c, kind: df.select(F.col(c).alias("key"), F.lit(kind).alias("kind"))
    return union_distinct(
        branch(t.customer, "c_nationkey", "nation"),
        branch(t.supplier, "s_nationkey", "nation"),
        branch(t.lineitem, "l_linenumber", "line"),
    )


@query(
    """SELECT role, kind, count(*) AS rows FROM (SELECT role, 'turn' AS kind FROM conversations
    UNION ALL SELECT lang, 'doc' FROM documents) GROUP BY 1, 2"""
)
def append_batches(t):
    batches = append_all(
        t.conversations.select("role", F.lit("turn").alias("kind")),
        t.documents.select(F.col("lang").alias("role"), F.lit("doc").alias("kind")),
    )
    return batches.groupBy("role", "kind").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 20", "top_rows")
def top_orders(t):
    return top_rows(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"], 100, 20)


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_size >= 40")
def table_function(t):
    return at_least(t.part, "p_size", 40, ["p_partkey", "p_name", "p_brand"])


@query(
    """SELECT c.o_custkey, c_name, o_orderkey, 'Employee' AS kind, TIMESTAMP '2004-06-30 23:59:59.998' AS accounting_end
    FROM orders c JOIN customer ON o_custkey = c_custkey WHERE o_custkey = 7"""
)
def contact_lookup_hit(t):
    people = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    found = contact_lookup(people, t.orders.select("o_custkey", "o_orderkey"), "o_custkey", 7)
    return found.withColumn("accounting_end", accounting_end("20040701"))


@query("SELECT count(*) AS rows FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey = NULL")
def contact_lookup_null(t):
    people = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return contact_lookup(people, t.orders.select("o_custkey", "o_orderkey"), "o_custkey", None).agg(
        F.count(F.lit(1)).alias("rows")
    )


@query("SELECT event_id, nullif(event_type, 'error') AS kind FROM events WHERE nullif(event_type, 'error') IS NOT NULL")
def view_filter(t):
    rows = t.events.select("event_id", F.nullif(F.col("event_type"), F.lit("error")).alias("kind"))
    return filtered_view(rows, "named_events", ["event_id", "kind"], "kind")


@query(
    """SELECT 'all' AS scope, count(*) AS rows FROM customer UNION ALL
    SELECT 'one', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'"""
)
def optional_parameter(t):
    count = lambda df, scope: df.agg(F.lit(scope).alias("scope"), F.count(F.lit(1)).alias("rows"))
    return append_all(
        count(only(t.customer, "c_mktsegment", ""), "all"), count(only(t.customer, "c_mktsegment", "BUILDING"), "one")
    )


@query(
    """SELECT page_id, u.word AS word FROM (SELECT page_id, unnest(string_split(split_part(url, '://', 2), '/')) AS word FROM pages) u
    WHERE u.word <> ''"""
)
def expand_rows(t):
    words = F.split(F.substring_index("url", "://", -1), "/")
    return expand(t.pages.select("page_id", words.alias("w")), F.col("w"), "word").drop("w").filter(F.col("word") != "")


@query(
    """SELECT s_suppkey, n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey""",
    "lookup",
)
def lookup_nation(t):
    some = t.nation.filter(F.col("n_regionkey") < 3)
    return lookup(t.supplier, some, "s_nationkey", "n_nationkey", {"n_name": "n_name"}).select("s_suppkey", "n_name")

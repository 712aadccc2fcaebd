"""Queries for scalar functions, files, and table changes on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shapewright.functions import binary, nulls, numeric, temporal, text
from shapewright.operators.changes import (
    append_history,
    apply_update,
    check_rows,
    fill_on_change,
    history,
    history_from_feed,
    history_schema,
    qualify,
    quarantine,
    set_from_rules,
    shift_keys,
    upsert,
)
from shapewright.operators.sets import append_all
from shapewright.plans.registry import query
from shapewright.session import new_folder
from shapewright.sources.blobs import path_projection, read_blobs, write_blobs
from shapewright.sources.keyed import KeyedTable
from shapewright.sources.tables import materialise

ORDER_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"]


@query(
    r"""SELECT p_partkey, 'P:' || p_name AS joined, substr(p_name, 1, 2) AS sub0, left(p_name, 3) AS l3, right(p_name, 2) AS r2,
    right('000000' || CAST(p_partkey AS VARCHAR), 6) AS padded, length(rtrim(p_name || '  ')) AS len, strlen(p_name) AS bytes,
    string_split(p_name, ' ')[-1] AS last_word, regexp_replace(p_name, ' [^ ]*$', '') AS but_last, 'X' || substr(p_brand, 2) AS stuffed,
    '[' || replace(p_brand, ']', ']]') || ']' AS quoted, replace(p_brand, 'Brand', 'B') AS replaced, lower(p_type) AS low,
    p_type ILIKE 'econ%' AS like_ci, lower(p_type) = 'economy' AS same_ci, p_name || ' of ' || p_brand || chr(10) AS line,
    substr(p_name, 2, 2) AS cut, coalesce(substr(nullif(p_type, 'PROMO'), 1, 3), 'none') AS filled,
    coalesce('[' || nullif(p_type, 'PROMO') || '].[' || p_brand || ']', '') AS qualified FROM part""",
    "strings",
)
def part_strings(t):
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return t.part.select(
        "p_partkey",
        F.concat(F.lit("P:"), name).alias("joined"),
        text.substring_from(name, 0, 3).alias("sub0"),
        F.left(name, F.lit(3)).alias("l3"),
        F.right(name, F.lit(2)).alias("r2"),
        text.zero_pad(F.col("p_partkey"), 6).alias("padded"),
        text.text_length(F.concat(name, F.lit("  "))).cast("long").alias("len"),
        text.data_length(name).cast("long").alias("bytes"),
        text.after_last(name, " ").alias("last_word"),
        text.before_last(name, " ").alias("but_last"),
        text.stuff(brand, 1, 1, "X").alias("stuffed"),
        text.quote_name(brand).alias("quoted"),
        F.replace(brand, F.lit("Brand"), F.lit("B")).alias("replaced"),
        F.lower(kind).alias("low"),
        text.contains_text(kind, "econ%").alias("like_ci"),
        text.same_text(kind, "economy").alias("same_ci"),
        text.fill_template("{name} of {brand}\n", name=name, brand=brand).alias("line"),
        text.slice_by_bytes(name, F.lit(2), F.lit(4)).alias("cut"),
        nulls.or_default(F.left(F.nullif(kind, F.lit("PROMO")), F.lit(3)), "none").alias("filled"),
        text.qualified_name(F.nullif(kind, F.lit("PROMO")), brand).alias("qualified"),
    )


@query(
    """SELECT o_orderkey, o_orderkey // 7 AS quotient, o_orderkey % 7 AS rest, (0 - o_orderkey) // 7 AS negative,
    CAST(o_orderkey / 128.0 AS DECIMAL(14,2))::DOUBLE AS mb, CAST(((o_orderkey + 300) // 600) / 100 AS DECIMAL(10,2))::DOUBLE AS minutes,
    round(coalesce(CAST(o_custkey AS DOUBLE) / nullif(o_orderkey % 5, 0), 0), 2) AS ratio,
    CAST(32767 AS BIGINT) AS lim, o_orderkey / 1048576 AS from_bytes, o_orderkey / 32767 AS used FROM orders""",
    "numbers",
)
def order_numbers(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey",
        numeric.int_divide(k, 7).alias("quotient"),
        (k % 7).alias("rest"),
        numeric.int_divide(-k, 7).alias("negative"),
        numeric.pages_to_mb(k).cast("decimal(14,2)").alias("mb"),
        numeric.minutes_from_ms(k).alias("minutes"),
        numeric.safe_ratio(F.col("o_custkey"), k % 5).alias("ratio"),
        numeric.key_limit(16).alias("lim"),
        numeric.bytes_to_mb(k).alias("from_bytes"),
        numeric.share_used(k, numeric.key_limit(16)).alias("used"),
    )


@query(
    """SELECT event_id, CAST(strftime(ts, '%Y%m%d') AS INT) AS day, CAST(strftime(ts, '%H%M%S') AS INT) AS clock,
    date_trunc('second', ts) AS decoded, ts + INTERVAL 3 DAYS AS later, ts - INTERVAL 2 MILLISECONDS AS sooner,
    datediff('second', ts, TIMESTAMP '2024-01-31') AS seconds, datediff('millisecond', ts, TIMESTAMP '2024-01-31') AS millis,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS style20, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS style121 FROM events""",
    "dates",
)
def event_dates(t):
    ts, end = F.col("ts"), temporal.moment("2024-01-31")
    day, clock = temporal.date_to_int(ts), temporal.time_to_int(ts)
    return t.events.select(
        "event_id",
        day.alias("day"),
        clock.alias("clock"),
        temporal.decode_datetime(day, clock).alias("decoded"),
        temporal.shift(ts, "DAY", 3).alias("later"),
        temporal.shift(ts, "MILLISECOND", -2).alias("sooner"),
        temporal.seconds_between(ts, end).alias("seconds"),
        temporal.millis_between(ts, end).alias("millis"),
        temporal.canonical_text(ts).alias("style20"),
        temporal.canonical_text(ts, millis=True).alias("style121"),
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, '0x' || upper(hex(encode(event_type))) AS hexed FROM events")
def json_field(t):
    hexed = binary.hex_text(F.encode("event_type", "UTF-8"))
    return t.events.select("event_id", binary.json_text(F.col("props"), "$.k").alias("k"), hexed.alias("hexed"))


@query(
    r"""SELECT page_id, replace(url, '/', '\') AS path, hex(encode(html)) AS html, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder,
    regexp_replace(string_split(url, '/')[-1], '(?i)\.html$', '') AS leaf FROM pages WHERE url NOT LIKE '%?%'"""
)
def path_split(t):
    plain = t.pages.filter(~F.col("url").like("%?%"))
    leaf = text.strip_extension(text.after_last(F.col("url"), "/"), "html")
    placed = plain.withColumn("folder", text.folder_of(F.col("url"))).withColumn("leaf", leaf)
    return path_projection(placed, "url", "html").withColumnRenamed("url", "path")


EDITED = """(SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
    CASE o_orderpriority WHEN '2-HIGH' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate
    FROM orders WHERE o_orderpriority <> '3-MEDIUM' OR o_orderstatus <> 'F'
    UNION ALL SELECT o_orderkey + 1000000000000, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderpriority = '5-LOW')"""


def edited_orders(t):
    """The orders as they might look later: urgent ones in a new status, high ones dearer, the closed
    medium ones gone, and each low one there a second time under a new key."""
    priority = F.col("o_orderpriority")
    kept = t.orders.filter((priority != "3-MEDIUM") | (F.col("o_orderstatus") != "F"))
    edited = kept.withColumn("o_orderstatus", F.when(priority == "1-URGENT", "X").otherwise(F.col("o_orderstatus")))
    price = F.col("o_totalprice")
    edited = edited.withColumn("o_totalprice", F.when(priority == "2-HIGH", price + 1).otherwise(price))
    new = t.orders.filter(priority == "5-LOW").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000_000)
    return edited.select(*ORDER_COLUMNS).unionByName(new.select(*ORDER_COLUMNS))


DIFF = f"""SELECT CASE WHEN b.o_orderkey IS NULL THEN 1 WHEN a.o_orderkey IS NULL THEN 3 ELSE 2 END AS history_type,
    coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN b.o_orderstatus ELSE a.o_orderstatus END AS o_orderstatus,
    CASE WHEN a.o_orderkey IS NULL THEN b.o_totalprice ELSE a.o_totalprice END AS o_totalprice, TIMESTAMP '2024-01-31' AS o_orderdate
    FROM orders b FULL JOIN {EDITED} a ON a.o_orderkey = b.o_orderkey
    WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus"""


@query(DIFF)
def history_diff(t):
    before = t.orders.select(*ORDER_COLUMNS)
    return history(before, edited_orders(t), "o_orderkey", ["o_orderstatus"], "o_orderdate", "2024-01-31")


@query(f"SELECT 100 + row_number() OVER (ORDER BY o_orderkey) AS history_id, * FROM ({DIFF}) UNION ALL SELECT 100, 1, * REPLACE (TIMESTAMP '2024-01-31' AS o_orderdate) FROM (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders))")
def history_append(t):
    before = t.orders.select(*ORDER_COLUMNS)
    changes = history(before, edited_orders(t), "o_orderkey", ["o_orderstatus"], "o_orderdate", "2024-01-31")
    first = before.filter(F.col("o_orderkey") == before.agg(F.min("o_orderkey")).scalar())
    log = first.select(
        F.lit(100).cast("long").alias("history_id"),
        F.lit(1).alias("history_type"),
        *[temporal.moment("2024-01-31").alias(c) if c == "o_orderdate" else F.col(c) for c in ORDER_COLUMNS],
    )
    names = history_schema(before).names
    return append_history(log.select(*names), changes, "o_orderkey")


@query(
    """SELECT CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS history_type, user_id, value FROM events
    WHERE event_type IN ('signup', 'error') OR (event_type = 'purchase' AND value > 10)"""
)
def history_feed(t):
    return history_from_feed(event_feed(t.events), "op", "watched")


def event_feed(events):
    op = (
        F.when(F.col("event_type") == "signup", "insert")
        .when(F.col("event_type") == "purchase", "update")
        .when(F.col("event_type") == "error", "delete")
    )
    return events.select(op.alias("op"), (F.col("value") > 10).alias("watched"), "user_id", "value")


UPSERTED = f"""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN b.o_orderstatus ELSE a.o_orderstatus END AS o_orderstatus,
    CASE WHEN a.o_orderkey IS NULL THEN b.o_totalprice ELSE a.o_totalprice END AS o_totalprice,
    CASE WHEN a.o_orderkey IS NULL THEN b.o_orderdate ELSE a.o_orderdate END AS o_orderdate
    FROM orders b FULL JOIN {EDITED} a ON a.o_orderkey = b.o_orderkey"""


@query(UPSERTED, "upsert")
def upsert_orders(t):
    return upsert(t.orders.select(*ORDER_COLUMNS), edited_orders(t), "o_orderkey")


@query(UPSERTED, "upsert_table")
def merge_orders(t):
    """The same as a change of a keyed table, which rewrites only the files that hold edited keys."""
    table = KeyedTable(t.spark, new_folder(t.spark, "orders-table"))
    table.create(t.orders.select(*ORDER_COLUMNS), "o_orderkey", buckets=8, rows_per_file=50_000)
    table.merge(edited_orders(t))
    return table.read()


@query(
    """SELECT c_custkey, CASE WHEN u.user_id IS NULL THEN c_name ELSE event_type END AS c_name, CASE WHEN u.user_id IS NULL THEN c_acctbal ELSE value END AS c_acctbal
    FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events
    WHERE event_type = 'purchase') WHERE n = 1) u ON user_id = c_custkey""",
    "apply_update",
)
def update_customers(t):
    changes = t.events.filter(F.col("event_type") == "purchase").withColumnRenamed("user_id", "c_custkey")
    target = t.customer.select("c_custkey", "c_name", "c_acctbal")
    columns = {"c_name": "event_type", "c_acctbal": "value"}
    return apply_update(target, changes, "c_custkey", columns, [F.col("ts").desc(), F.col("event_id").desc()])


@query(
    """SELECT user_id AS id, ts AS changed, CAST(value AS DECIMAL(19,4))::DOUBLE AS rate FROM events WHERE event_type = 'purchase'
    UNION ALL SELECT c_custkey, TIMESTAMP '2023-12-31', CAST(c_acctbal AS DECIMAL(19,4))::DOUBLE FROM customer"""
)
def pay_log(t):
    """The dated rows an update appends beside the changed table."""
    log = t.customer.select(
        F.col("c_custkey").alias("id"),
        temporal.moment("2023-12-31").alias("changed"),
        F.col("c_acctbal").cast("decimal(19,4)").alias("rate"),
    )
    changes = t.events.filter(F.col("event_type") == "purchase")
    new = changes.select(
        F.col("user_id").alias("id"), F.col("ts").alias("changed"), F.col("value").cast("decimal(19,4)").alias("rate")
    )
    return append_all(log, new)


@query("SELECT CASE WHEN o_orderkey BETWEEN 101 AND 120 THEN o_orderkey - 100 ELSE o_orderkey END AS o_orderkey, o_orderstatus FROM orders", "shift_keys")
def shift_order_keys(t):
    return shift_keys(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", 101, 120, -100)


@query(
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 WHEN left(c_mktsegment, 1) = 'M' THEN 2 ELSE 4 END AS c_nationkey FROM customer""",
    "set_from_rules",
)
def rank_segments(t):
    rule = F.when(F.col("c_mktsegment") == "BUILDING", 1).when(F.left("c_mktsegment", F.lit(1)) == "M", 2).otherwise(4)
    return set_from_rules(t.customer, "c_nationkey", rule).select("c_custkey", "c_nationkey")


@query("SELECT s_suppkey, r_name || '.' || n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "qualify")
def qualify_nations(t):
    homes = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("name"))
    return qualify(rows, "name", homes.select(F.concat("r_name", F.lit("."), "n_name").alias("full_name")), "full_name")


@query(
    """SELECT doc_id, error FROM (SELECT doc_id, CASE WHEN TRY_CAST(split_part(text, ' ', 1) AS BIGINT) IS NULL THEN 'no number'
    WHEN n_chars <= 100 THEN 'short' END AS error FROM documents) WHERE error IS NOT NULL""",
    "quarantine",
)
def quarantine_documents(t):
    checks = {
        "no number": nulls.to_number(F.substring_index("text", " ", 1), "bigint").isNotNull(),
        "short": F.col("n_chars") > 100,
    }
    return quarantine(t.documents, checks)[1].select("doc_id", "error")


@query(
    """SELECT coalesce(error, 'good') AS outcome, count(*) AS rows FROM (SELECT CASE WHEN TRY_CAST(string_split(url, '/')[-1] AS BIGINT) IS NULL THEN 'no number' END AS error FROM pages) GROUP BY 1"""
)
def quarantine_counts(t):
    checked = check_rows(t.pages, {"no number": nulls.to_number(text.after_last(F.col("url"), "/"), "bigint").isNotNull()})
    return checked.groupBy(F.coalesce("error", F.lit("good")).alias("outcome")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '<survey><total>0.00</total></survey>' WHEN 1 THEN '<survey><total>5</total></survey>'
    WHEN 2 THEN '<survey><total>0.00</total><name>' || p_name || '</name></survey>' ELSE '<survey><name>' END AS doc FROM part""",
    "fill_on_change",
)
def fill_part_docs(t):
    k = F.col("p_partkey") % 4
    doc = (
        F.when(k == 1, "<survey><total>5</total></survey>")
        .when(k == 2, F.concat(F.lit("<survey><name>"), "p_name", F.lit("</name></survey>")))
        .when(k == 3, "<survey><name>")
    )
    return fill_on_change(t.part.select("p_partkey", doc.alias("doc")), "doc", "survey", "total", "<total>0.00</total>")


@query("SELECT o_custkey, count(*) AS orders, max(o_orderdate) AS last FROM orders GROUP BY 1")
def materialised_reuse(t):
    rows = materialise(t.orders.select("o_custkey", "o_orderdate"), new_folder(t.spark, "orders"))
    return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderdate").alias("last"))


@query("SELECT '/' || split_part(url, '/', 4) AS folder, 'page' || page_id AS name, hex(encode(html)) AS content FROM pages", "blob_round_trip")
def page_files(t):
    root = new_folder(t.spark, "pages")
    path = text.fill_template("/{lang}/page{id}.html", lang=F.split_part("url", F.lit("/"), F.lit(4)), id=F.col("page_id"))
    written = write_blobs(t.pages.select(path.alias("path"), "html"), "path", "html", root)
    failed = written.filter(~F.col("ok")).count()
    if failed:
        raise RuntimeError(f"{failed} files were not written")
    return read_blobs(t.spark, root, "*.html", "html")

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shapewright.functions import binary as B
from shapewright.functions import nulls as N
from shapewright.functions import numeric as M
from shapewright.functions import temporal as D
from shapewright.functions import text as X

def at(text):
    return F.lit(text).cast("timestamp_ntz")


def cases():
    L = F.lit
    return [
        ("start 0 costs a character", X.substring_from, (L("abcdef"), 0, 3), "ab"),
        ("start 2", X.substring_from, (L("abcdef"), 2, 3), "bcd"),
        ("start far below", X.substring_from, (L("abcdef"), -5, 3), ""),
        ("pad short", X.zero_pad, (L(7), 6), "000007"),
        ("pad keeps the right end", X.zero_pad, (L(1234567), 6), "234567"),
        ("LEN skips trailing blanks", X.text_length, (L(" a  "),), 2),
        ("DATALENGTH wide", X.data_length, (L("ab "), True), 6),
        ("after last dot", X.after_last, (L("a.b.c"), "."), "c"),
        ("no dot gives all", X.after_last, (L("abc"), "."), "abc"),
        ("before last backslash", X.before_last, (L("c:\\x\\y"), "\\"), "c:\\x"),
        ("no backslash gives all", X.before_last, (L("y"), "\\"), "y"),
        ("after first dot", X.after_first, (L("dbo.a.b"), "."), "a.b"),
        ("stuff drops the separator", X.stuff, (L(",a,b"), 1, 1, ""), "a,b"),
        ("stuff outside is NULL", X.stuff, (L("abc"), 4, 1, "x"), None),
        ("quote doubles the bracket", X.quote_name, (L("a]b"),), "[a]]b]"),
        ("folder", X.folder_of, (L("/a/b/r.rdl"),), "/a/b"),
        ("no folder", X.folder_of, (L("r"),), ""),
        ("empty path", X.folder_of, (L(""),), ""),
        ("extension in any case", X.strip_extension, (L("b.RDL"), "rdl"), "b"),
        ("extension only at the end", X.strip_extension, (L("rxrdl"), "rdl"), "rxrdl"),
        ("equal without case and trailing blanks", X.same_text, (L("Ab "), "aB"), True),
        ("LIKE without case", X.contains_text, (L("an ERROR"), "%Error%"), True),
        ("LIKE with case", X.contains_text, (L("an ERROR"), "%Error%", False), False),
        ("underscore is one character", X.contains_text, (L("syncobjX1"), "syncobj_%"), True),
        ("NULL is no match", X.contains_text, (L(None).cast("string"), "%x%"), None),
        ("statement to the end", X.slice_by_bytes, (L("select 1"), L(14), L(-1)), "1"),
        ("statement between offsets", X.slice_by_bytes, (L("select 1"), L(4), L(8)), "lec"),
        ("division truncates", M.int_divide, (L(-7), 2), -3),
        ("ratio by zero is zero", M.safe_ratio, (L(1), L(0)), 0.0),
        ("ratio", M.safe_ratio, (L(1), L(3)), 0.33),
        ("limit of int", M.key_limit, (32,), 2147483647),
        ("limit of bigint", M.key_limit, (64,), 9223372036854775807),
        ("negative key", M.share_used, (L(-5), L(10)), 0.5),
        ("seconds are crossed boundaries", D.seconds_between, (at("2024-01-01 00:00:00.9"), at("2024-01-01 00:00:01.1")), 1),
        ("before 1970 too", D.seconds_between, (at("1969-12-31 23:59:58.9"), at("1970-01-01 00:00:00.1")), 2),
        ("a year with a clock change", D.seconds_between, (at("2024-01-01"), at("2024-07-01")), 182 * 86400),
        ("milliseconds are boundaries", D.millis_between, (at("2024-01-01 00:00:00.0009"), at("2024-01-01 00:00:00.001")), 1),
        ("zone and back", lambda ts: D.utc_wall_time(D.utc_instant(ts)), (at("2024-03-10 02:30:00.123456"),), datetime(2024, 3, 10, 2, 30, 0, 123456)),
        ("open end is NULL", D.seconds_between, (at("2024-01-01"), at(None)), None),
        ("end before start", D.millis_between, (at("2024-01-01 00:00:01"), at("2024-01-01")), -1000),
        ("midnight", D.decode_datetime, (L(20240131), L(0)), datetime(2024, 1, 31)),
        ("one second", D.decode_datetime, (L(20240131), L(1)), datetime(2024, 1, 31, 0, 0, 1)),
        ("last second", D.decode_datetime, (L(20240131), L(235959)), datetime(2024, 1, 31, 23, 59, 59)),
        ("no date", D.decode_datetime, (L(20241399), L(0)), None),
        ("short duration", D.duration_text, (L(7),), "00:00:07"),
        ("long duration", D.duration_text, (L(1234567),), "123:45:67"),
        ("day before", D.shift, (at("2024-03-01"), "DAY", -1), datetime(2024, 2, 29)),
        ("accounting end", D.accounting_end, ("20040701",), datetime(2004, 6, 30, 23, 59, 59, 998000)),
        ("style 121", D.canonical_text, (at("2024-01-31 01:02:03.456"), True), "2024-01-31 01:02:03.456"),
        ("hex", B.hex_text, (L(b"\x01\xff"),), "0x01FF"),
        ("position", B.position_text, (L("00000020:000000a8:0001"),), "32:168:1"),
        ("position is signed", B.position_text, (L("ffffffff:0:1"),), "-1:0:1"),
        ("short position", B.position_text, (L("zz"),), None),
        ("element there, any namespace", B.xml_has, (L("<a xmlns='u'><b>1</b></a>"), "/a/b"), True),
        ("element missing", B.xml_has, (L("<a><c/></a>"), "/a/b"), False),
        ("malformed", B.xml_has, (L("<a><b>"), "/a/b"), False),
        ("insert first", B.xml_insert_first, (L("<a x='1'><c/></a>"), "a", "<b>0</b>"), "<a x='1'><b>0</b><c/></a>"),
        ("insert in empty root", B.xml_insert_first, (L("<a/>"), "a", "<b>0</b>"), "<a><b>0</b></a>"),
        ("json", B.json_text, (L('{"k": 87}'), "$.k"), "87"),
        ("bad number", N.to_number, (L("x"), "int"), None),
        ("default", N.or_default, (L(None).cast("int"), 0), 0),
    ]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_all_cases(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    known = cases()
    made = spark.range(1).select(*[fn(*args).alias(f"c{i}") for i, (_, fn, args, _) in enumerate(known)]).first()
    wrong = {c[0]: (made[i], c[3]) for i, c in enumerate(known) if made[i] != c[3]}
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert not wrong


def test_template_null_spreads(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "name string, n int")
    made = df.select(X.fill_template("<{name}:{n}>", name=F.col("name"), n=F.col("n")).alias("t"))
    assert [r.t for r in made.collect()] == ["<a:1>", None]


def test_day_number():
    assert D.day_number("2024-01-31", 1) == 20240201
    with pytest.raises(ValueError):
        D.day_number("no date")

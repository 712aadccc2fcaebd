"""Hexadecimal text, and XML or JSON held in strings or bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_text(col: Column) -> Column:
    """0x followed by upper-case hexadecimal digits."""
    return F.concat(F.lit("0x"), F.hex(col))


def hex_to_int(text: Column) -> Column:
    """Hexadecimal digits as a signed 32-bit integer; NULL if they are none."""
    wide = F.when(text.rlike("^[0-9a-fA-F]{1,8}$"), F.conv(text, 16, 10).cast("long"))
    return F.when(wide >= 2**31, wide - 2**32).otherwise(wide)


def position_text(text: Column) -> Column:
    """Three hexadecimal fields "xxxxxxxx:xxxxxxxx:xxxx" as decimal numbers "a:b:c"."""
    parts = F.split(text, ":")
    fields = [hex_to_int(F.get(parts, F.lit(i))).cast("string") for i in range(3)]
    return F.concat(fields[0], F.lit(":"), fields[1], F.lit(":"), fields[2])


def bytes_to_text(col: Column) -> Column:
    return F.decode(col, "UTF-8")


def is_xml(doc: Column) -> Column:
    """False for text that does not parse; xpath functions would raise on it."""
    parsed = F.from_xml(doc, "_corrupt_record STRING, _any STRING", {"columnNameOfCorruptRecord": "_corrupt_record"})
    return doc.isNotNull() & parsed["_corrupt_record"].isNull()


def xml_has(doc: Column, path: str) -> Column:
    """True if the element exists, whatever its namespace; False for text that is no XML."""
    return F.when(is_xml(doc), F.xpath_boolean(doc, F.lit(path))).otherwise(F.lit(False))


def xml_insert_first(doc: Column, root: str, element: str) -> Column:
    """Puts the element first into the root element."""
    opened = F.regexp_replace(doc, rf"^(\s*<{root}(?:\s[^>]*)?)/>\s*$", f"$1></{root}>")
    return F.regexp_replace(opened, rf"^(\s*<{root}(?:\s[^>]*)?>)", f"$1{element}")


def json_text(col: Column, path: str) -> Column:
    """A JSON value as text; NULL where the path is missing."""
    return F.get_json_object(col, path)

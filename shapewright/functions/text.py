"""String expressions. Positions are 1-based; a NULL input gives NULL."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def substring_from(col: Column, start: int, length: int) -> Column:
    """SUBSTRING where a start below 1 uses up part of the length, as T-SQL counts it."""
    end = start + length
    start = max(start, 1)
    return F.substring(col, start, max(end - start, 0))


def zero_pad(col: Column, width: int) -> Column:
    """The last ``width`` characters after zeros are put in front; lpad would keep the first ones."""
    return F.right(F.concat(F.lit("0" * width), col.cast("string")), F.lit(width))


def text_length(col: Column) -> Column:
    """LEN: trailing spaces do not count."""
    return F.length(F.rtrim(col))


def data_length(col: Column, wide: bool = False) -> Column:
    """DATALENGTH in bytes; ``wide`` counts two bytes a character."""
    return F.length(col) * 2 if wide else F.octet_length(col)


def after_last(col: Column, sep: str) -> Column:
    """Text after the last separator; the whole text if there is none."""
    return F.substring_index(col, sep, -1)


def before_last(col: Column, sep: str) -> Column:
    """Text before the last separator; the whole text if there is none."""
    from_end = F.instr(F.reverse(col), sep)
    return F.left(col, F.length(col) - from_end)


def after_first(col: Column, sep: str) -> Column:
    """Text after the first separator; the whole text if there is none."""
    return F.substring(col, F.instr(col, sep) + F.lit(len(sep)), F.length(col))


def stuff(col: Column, start: int, length: int, insert: Column | str) -> Column:
    """Replaces ``length`` characters from ``start``; NULL if the start lies outside the text."""
    new = F.lit(insert) if isinstance(insert, str) else insert
    inside = (F.lit(start) >= 1) & (F.lit(start) <= F.length(col))
    return F.when(inside, F.overlay(col, new, F.lit(start), F.lit(length)))


def quote_name(col: Column) -> Column:
    """[name] with ] doubled."""
    return F.concat(F.lit("["), F.replace(col, F.lit("]"), F.lit("]]")), F.lit("]"))


def qualified_name(*parts: Column) -> Column:
    """[a].[b].[c]; empty if any part is missing."""
    pieces = [quote_name(parts[0])]
    for part in parts[1:]:
        pieces += [F.lit("."), quote_name(part)]
    return F.coalesce(F.concat(*pieces), F.lit(""))


def folder_of(path: Column, sep: str = "/") -> Column:
    """Everything before the last separator; empty if there is none."""
    return F.regexp_extract(path, f"^(.*){re.escape(sep)}[^{re.escape(sep)}]*$", 1)


def strip_extension(name: Column, extension: str) -> Column:
    """Drops the extension at the end of the name, in any case."""
    return F.regexp_replace(name, rf"(?i)\.{re.escape(extension)}$", "")


def same_text(left: Column, right: Column | str) -> Column:
    """Equality without case and without trailing spaces."""
    right = F.lit(right) if isinstance(right, str) else right
    return F.collate(F.rtrim(left), "UTF8_LCASE") == F.collate(F.rtrim(right), "UTF8_LCASE")


def contains_text(col: Column, pattern: str, case_insensitive: bool = True) -> Column:
    """LIKE, by default without case, as the usual collations compare."""
    return col.ilike(pattern) if case_insensitive else col.like(pattern)


def fill_template(template: str, **columns: Column) -> Column:
    """"{name}" places in the template filled per row; NULL in any of them gives NULL."""
    pieces = []
    for at, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if at % 2:
            pieces.append(columns[piece].cast("string"))
        elif piece:
            pieces.append(F.lit(piece))
    return F.concat(*pieces)


def slice_by_bytes(col: Column, start: Column, end: Column) -> Column:
    """The statement between two byte offsets of two-byte text; end -1 means to the end."""
    last = F.when(end == -1, F.length(col) * 2).otherwise(end)
    half = lambda c: F.floor(c / 2).cast("int")
    return F.substring(col, half(start) + 1, half(last - start) + 1)

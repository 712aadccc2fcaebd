"""URL filters: host and path rules, and a weighted vocabulary of strict and soft terms.

An Aho-Corasick automaton counts the terms that stand alone in a URL, that is with no letter or digit
before or after. A URL with one strict hit, or with several distinct soft terms, is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from shapewright.llm.common import lower_az, table

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
STRICT = ("casino", "porn", "xxx", "viagra", "escort", "warez", "spam", "pills")
SOFT = ("free", "bets", "win", "cheap", "adult", "ads", "track", "bonus", "jackpot", "loan", "farm", "deal", "hot", "cash")
MIN_SOFT = 2


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased. Empty without ``://``."""
    return lower_az(F.regexp_extract(_after(url), r"^([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end. Empty without ``://``."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits. ``rules``: a short list in code."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [
        ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)) for h, p, _ in ordered
    ]
    rule = F.coalesce(*[F.when(f, F.lit(h + p)) for f, (h, p, _) in zip(fits, ordered, strict=True)])
    verdict = F.coalesce(*[F.when(f, F.lit(v)) for f, (_, _, v) in zip(fits, ordered, strict=True)])
    return rule, verdict


def automaton(strict, soft) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term, (term, False))
    for term in strict:
        found.add_word(term, (term, True))
    found.make_automaton()
    return found


def count_terms(url: str | None, found: ahocorasick.Automaton) -> tuple[int, int, set[str]]:
    """Places of strict terms, places of soft terms, and the distinct soft terms."""
    url = (url or "").lower() if (url or "").isascii() else "".join(c.lower() if c.isascii() else c for c in url or "")
    strict = soft = 0
    kinds = set()
    for last, (term, hard) in found.iter(url):
        first = last - len(term) + 1
        alone = not (first and _joins(url[first - 1])) and not (last + 1 < len(url) and _joins(url[last + 1]))
        if alone and hard:
            strict += 1
        elif alone:
            soft += 1
            kinds.add(term)
    return strict, soft, kinds


def _joins(char: str) -> bool:
    return char.isascii() and char.isalnum()


def scan_urls(df: DataFrame, url: str, strict=STRICT, soft=SOFT, min_soft: int = MIN_SOFT, keep=()) -> DataFrame:
    """``keep`` columns, url, strict_hits, soft_hits, soft_terms (sorted list) and rejected, for each row.

    A term listed as strict and soft is strict. A null url has no hits. Rows are handled one by one, so
    repeated rows, ties and order do not matter; other columns are not read.
    """
    narrow = df.select(*keep, url)
    schema = StructType(list(narrow.schema.fields))
    for name, kind in (("strict_hits", "long"), ("soft_hits", "long"), ("soft_terms", ArrayType(StringType())), ("rejected", "boolean")):
        schema = schema.add(name, kind)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(strict, soft)
        for batch in batches:
            counted = [count_terms(u, found) for u in batch.column(url).to_pylist()]
            more = [
                pa.array([c[0] for c in counted], pa.int64()),
                pa.array([c[1] for c in counted], pa.int64()),
                pa.array([sorted(c[2]) for c in counted], pa.list_(pa.string())),
                pa.array([c[0] > 0 or len(c[2]) >= min_soft for c in counted], pa.bool_()),
            ]
            names = [*batch.schema.names, "strict_hits", "soft_hits", "soft_terms", "rejected"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=names)

    return narrow.mapInArrow(scan, schema)


def op5_urls(spark, sf_dir: str) -> DataFrame:
    """Every page's url: its rule's verdict, else the vocabulary's."""
    scanned = scan_urls(table(spark, sf_dir, "pages"), "url", keep=("page_id",))
    parts = scanned.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    rule, verdict = longest_rule(F.col("host"), F.col("path"))
    own = F.when(F.col("rejected"), "block").otherwise("allow")
    return parts.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        "strict_hits", "soft_hits", F.array_join("soft_terms", ",").alias("soft_terms"),
    )


_LISTS = "['" + "','".join(STRICT) + "'] AS strict, ['" + "','".join(t for t in SOFT if t not in STRICT) + "'] AS soft"
OP5_SQL = rf"""
WITH cut AS (
  SELECT page_id, coalesce(url, '') AS u, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS after
  FROM pages
), split AS (
  SELECT page_id, u, translate(regexp_extract(after, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path, {_LISTS}
  FROM cut
), hits AS (
  SELECT *, [t FOR t IN regexp_split_to_array(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+') IF list_contains(strict, t)] AS s,
    [t FOR t IN regexp_split_to_array(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+') IF list_contains(soft, t)] AS f
  FROM split
), rules(rh, rp, rv) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fitting AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
  FROM (SELECT DISTINCT page_id, host, path FROM hits) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT h.page_id, h.host, h.path, r.rule,
  coalesce(r.rv, CASE WHEN len(s) > 0 OR len(list_distinct(f)) >= 2 THEN 'block' ELSE 'allow' END) AS verdict,
  len(s)::BIGINT AS strict_hits, len(f)::BIGINT AS soft_hits, array_to_string(list_sort(list_distinct(f)), ',') AS soft_terms
FROM hits h LEFT JOIN fitting r ON h.page_id IS NOT DISTINCT FROM r.page_id
"""

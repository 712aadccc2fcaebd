"""Personal data: fixed patterns, and bootstrapped contextual extraction of what they cannot describe.

What the fixed patterns find are the seeds. The words around seeds are lexical patterns; patterns and the
identifier-like strings that stand in them form a graph. A pattern is trusted as far as the distinct
strings in it are known to be of one kind, and a string as far as the patterns around it are trusted; both
scores are computed in turn. Strings in trusted patterns are reported with the pattern's kind.

Everything is DataFrame operations. Regular expressions use possessive repetition, so a text that is one
long run of digits or letters costs linear time and no deep recursion.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapewright.llm.common import Stages, table

KINDS = ("email", "ip", "card", "phone")
OTHER = "other"
_LOCAL = "[A-Za-z0-9._%+-]"
#: fixed values: the base patterns, written so that matches are the same but never found by trying back
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: a string that may be an identifier: what looks like a base match, or begins with a letter or digit and holds a digit
TOKEN = "|".join(
    [
        PATTERNS["phone"],
        PATTERNS["email"],
        r"[0-9](?:[\x20-]?[0-9]){13,}+",
        r"(?<![A-Za-z0-9_#./:@-])(?=[A-Za-z_#./:@-]*+[0-9])[A-Za-z0-9](?:[A-Za-z0-9_#/:@-]|\.(?=[A-Za-z0-9]))*+",
    ]
)
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_ADDRESS = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
SIDE = 64  # code points on either side in which the words of a context are looked for
ROUNDS = 2
MIN_SEEDS = 3.0  # distinct known strings that a pattern needs
MIN_TRUST = 0.8  # trust that patterns and strings need to be reported
MIN_LENGTH = 5  # of a reported string


def _luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check: from the right, every second one doubled, nines cast out."""
    each = F.reverse(F.split(digits, "(?<=.)(?=.)"))
    doubled = F.transform(
        each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))
    )
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def holds(kind: Column, value: Column) -> Column:
    """Whether a match of the kind's pattern counts."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    size = F.length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", value.rlike(_ADDRESS))
        .when((kind == "card") & size.between(14, 19), _luhn(digits))
        .when(kind == "phone", size.between(10, 15))
        .otherwise(False)
    )


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def matches(docs: DataFrame, patterns: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and found: an array of (kind, at, gap, value, left, right), for each row of ``docs``.

    ``gap`` is the length of what lies between a match and the one before of its kind. Splitting a text
    at a pattern gives the gaps, extracting it gives the matches, each in one pass over the text.
    """
    text = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    for kind, pattern in patterns.items():
        text = text.withColumn(f"_gaps_{kind}", F.split("_text", pattern, -1))
        text = text.withColumn(f"_hits_{kind}", F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))

    def listed(kind: str) -> Column:
        gaps = F.col(f"_gaps_{kind}")
        after = F.slice(gaps, 2, F.size(gaps))
        zipped = F.arrays_zip(gaps.alias("gap"), F.col(f"_hits_{kind}").alias("hit"), after.alias("after"))
        zipped = F.filter(zipped, lambda z: z["hit"].isNotNull())
        sides = kind == OTHER
        return F.transform(
            zipped,
            lambda z, i: F.struct(
                F.lit(kind).alias("kind"),
                i.alias("at"),
                F.char_length(z["gap"]).alias("gap"),
                z["hit"].alias("value"),
                (F.right(z["gap"], F.lit(SIDE)) if sides else F.lit(None).cast("string")).alias("left"),
                (F.left(z["after"], F.lit(SIDE)) if sides else F.lit(None).cast("string")).alias("right"),
            ),
        )

    return text.select(*keep, F.concat(*[listed(k) for k in patterns]).alias("found"))


def placed(found: DataFrame) -> DataFrame:
    """row, kind, start, end, value, left, right of each match; the window is one document's matches of a kind."""
    rows = found.select("row", F.inline("found"))
    upto = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.char_length("value")).over(upto)
    return rows.withColumn("end", end).select(
        "row", "kind", (F.col("end") - F.char_length("value")).alias("start"), "end", "value", "left", "right"
    )


def contexts(places: DataFrame) -> DataFrame:
    """row, start, end, value, kind (of a seed, else null) and pattern, for each pattern that a string stands in.

    Patterns are the two words before, and the word before with the word after, in small letters.
    """
    word = F.lit(r"[\p{L}\p{N}]+")
    left = F.regexp_extract_all(F.lower("left"), word, F.lit(0))
    right = F.regexp_extract_all(F.lower("right"), word, F.lit(0))
    strings = places.filter(F.col("kind") == OTHER).withColumn("_left", left).withColumn("_right", right)
    before, count = F.try_element_at("_left", F.lit(-1)), F.size("_left")
    patterns = F.array_compact(
        F.array(
            F.when(count >= 2, F.concat_ws(" ", F.try_element_at("_left", F.lit(-2)), before, F.lit("_"))),
            F.when((count >= 1) & (F.size("_right") >= 1), F.concat_ws(" ", before, F.lit("_"), F.try_element_at("_right", F.lit(1)))),
        )
    )
    kind = F.coalesce(
        *[F.when(F.col("value").rlike(_whole(PATTERNS[k])) & holds(F.lit(k), F.col("value")), k) for k in KINDS]
    )
    inner = reduce(lambda a, b: a | b, [F.col("value").rlike(PATTERNS[k]) for k in ("email", "ip", "phone")])
    strings = strings.withColumn("seed", kind).filter(F.col("seed").isNotNull() | ~inner)
    return strings.select("row", "start", "end", "value", F.col("seed").alias("kind"), F.explode(patterns).alias("pattern"))


def trusted(edges: DataFrame, stages: Stages, rounds: int = ROUNDS, min_seeds: float = MIN_SEEDS, min_trust: float = MIN_TRUST) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns (pattern, kind, trust) and strings (value, kind, trust) of the graph.

    ``edges``: distinct pattern, value, kind (null: not known). A pattern's trust is the share of its
    distinct strings known to be of the kind, each counted by its own trust; a string's is the chance that
    not all of its trusted patterns are wrong. Sums combine map-side, so a pattern with a third of all
    strings is no hot spot.
    """
    totals = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))
    seeds = edges.filter("kind IS NOT NULL").select("pattern", "kind", F.lit(1.0).alias("trust"))
    unknown = edges.filter("kind IS NULL").select("pattern", "value")
    strings = None
    for number in range(rounds):
        known = seeds if strings is None else seeds.unionByName(unknown.join(strings, "value").select("pattern", "kind", "trust"))
        sums = known.groupBy("pattern", "kind").agg(F.sum("trust").alias("known"), F.sum(F.floor("trust")).alias("seeds"))
        good = sums.join(totals, "pattern").withColumn("trust", F.col("known") / F.col("total"))
        good = good.filter((F.col("seeds") >= min_seeds) & (F.col("trust") >= min_trust))
        patterns = stages.write(f"pii-patterns-{number}", good.select("pattern", "kind", "trust"))
        wrong = F.exp(F.sum(F.log(F.lit(1.0) - F.least("trust", F.lit(0.99)))))
        scored = unknown.join(patterns, "pattern").groupBy("value", "kind").agg((F.lit(1.0) - wrong).alias("trust"))
        strings = stages.write(f"pii-strings-{number}", scored.filter(F.col("trust") >= min_trust))
    return patterns, strings


def find_personal_data(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), **limits) -> DataFrame:
    """``keep`` columns, base and spans for each row of ``docs``: arrays of (start, order, kind, end), in order.

    ``base`` are valid matches of the fixed patterns, ``spans`` those and the discovered strings. Starts
    count code points from 0, ends are exclusive. Documents without text have empty arrays. Repeated rows
    are reported each, but one string in one context counts once as evidence, however often it is
    repeated. Without seeds nothing is discovered. No documents: no rows. Columns not in ``keep`` are ignored.
    """
    stages = Stages(docs.sparkSession)
    found = matches(docs, PATTERNS | {OTHER: TOKEN}, keep).withColumn("row", F.monotonically_increasing_id())
    found = stages.write("pii-found", found)
    places = stages.write("pii-places", placed(found.filter(F.size("found") > 0)))
    base = places.filter(F.col("kind") != OTHER).filter(holds(F.col("kind"), F.col("value")))
    strings = stages.write("pii-contexts", contexts(places))
    edges = stages.write("pii-edges", strings.groupBy("pattern", "value").agg(F.max("kind").alias("kind")))
    patterns, values = trusted(edges, stages, **limits)
    new = strings.filter((F.col("kind").isNull()) & (F.char_length("value") >= MIN_LENGTH)).drop("kind")
    new = new.join(patterns.select("pattern", "kind", "trust"), "pattern").join(values.select("value", "kind"), ["value", "kind"])
    new = new.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("trust", "kind")).alias("kind"))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    span = F.struct("start", order.alias("order"), "kind", "end")
    listed = base.select("row", "kind", "start", "end", F.lit(True).alias("fixed")).unionByName(
        new.select("row", "kind", "start", "end", F.lit(False).alias("fixed"))
    )
    listed = listed.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("fixed"), span))).alias("base"), F.array_sort(F.collect_set(span)).alias("spans")
    )
    none = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>")
    return found.drop("found").join(listed, "row", "left").select(
        *keep, F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans")
    )


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; where spans overlap, the earlier one is named."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        tag = F.when(s["start"] >= state["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.concat(state["out"], gap, tag).alias("out"), F.greatest(s["end"], state["at"]).alias("at"))

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, finish))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [_count(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(F.encode(_listed(F.col("base")), "utf-8"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )

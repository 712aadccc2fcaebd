"""Benchmark decontamination by templates, so that re-parameterised questions are caught, too.

Numbers, names and units become typed placeholders. Windows of the resulting tokens are joined by hash
between documents and benchmark items, in three forms, so that neither the place of a name in its sentence
nor letter case matters: names as placeholders, every capitalised word as one, and all words as they are in
small letters. Where a window meets, the item is laid over the document on that diagonal and compared token
by token: words must be equal, values behind placeholders may differ but must map consistently: "Ann has
3 apples, Ann eats 2" may have become "Bob has 7 pears ..." only with Bob in both places. A window that
contradicts does not count. An item whose windows are covered to a large enough part is reported.

Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapewright.llm.common import Stages, table

WINDOW = 8
MIN_LITERALS = 4  # tokens of a window that are words, not placeholders
MIN_COVER = 0.5  # share of an item's windows that must be met
NAME, NUMBER, UNIT, FIRST = "\ue001", "\ue002", "\ue003", "\ue004"
#: fixed values: words that are units after a number
UNITS = (
    "mm|cm|m|km|inch|inches|foot|feet|yards?|miles?|mg|g|kg|tons?|tonnes?|ounces?|pounds?|lbs?|ml|l|liters?|litres?|gallons?|"
    "seconds?|minutes?|hours?|days?|weeks?|months?|years?|percent|degrees?|dollars?|cents?|euros?|kmh|mph|watts?|volts?"
)


def template_tokens(text: Column) -> Column:
    """The tokens of a text in small letters; those that may vary have their kind before their value.

    A name is a capitalised word after a small letter, comma, semicolon or colon and a space. Any other
    capitalised word has the kind ``FIRST``: it may be a name or begin a sentence. A unit is a listed word
    right after a number. Punctuation is dropped. A text without tokens gives an empty array.
    """
    text = F.coalesce(text, F.lit(""))
    # each pattern begins with what rules most places out; what stands before is looked at afterwards
    text = F.regexp_replace(text, r"(\p{Lu}(?<=[\p{Ll},;:]\s\p{Lu})[\p{L}\p{M}]++)", f"{NAME}$1")
    text = F.regexp_replace(text, rf"(\p{{Lu}}(?<![\p{{L}}\p{{M}}{NAME}]\p{{Lu}})[\p{{L}}\p{{M}}]*+)", f"{FIRST}$1")
    text = F.regexp_replace(text, r"([0-9]++(?:[.,][0-9]++)*+)", f" {NUMBER}$1 ")
    text = F.lower(text)
    # marks inside a number are part of its value
    between = rf"(?![a-z])(?:[^\p{{L}}\p{{M}}0-9.,{NAME}{NUMBER}{UNIT}{FIRST}]|[.,](?<![0-9][.,])|[.,](?![0-9]))++"
    text = F.trim(F.regexp_replace(text, between, " "))
    text = F.regexp_replace(text, rf"({NUMBER}[0-9.,]*+ )({UNITS})(?= |$)", f"$1{UNIT}$2")
    return F.array_remove(F.split(text, " "), "")


def _kind(token: Column) -> Column:
    return F.left(token, F.lit(1))


def _plain(token: Column) -> Column:
    return F.ltrim(token, F.lit(NAME + NUMBER + UNIT + FIRST))


_FORMS = ("_names", "_capitals", "_words")
#: how a token is hashed in windows: a word by its letters, a value by its kind
_WORD, _NAME, _NUMBER, _UNIT, _FIRST = range(5)


def _with_forms(rows: DataFrame) -> DataFrame:
    """Adds hashes of the tokens in the three forms that windows are joined in, and with all values (_values).

    Letters are hashed and kinds read once for each token, the forms are made from these numbers.
    """
    kind = lambda t: F.when(_kind(t) == NAME, _NAME).when(_kind(t) == NUMBER, _NUMBER).when(_kind(t) == UNIT, _UNIT).when(_kind(t) == FIRST, _FIRST).otherwise(_WORD)
    rows = rows.withColumns({"_values": F.transform("tokens", lambda t: F.xxhash64(_plain(t))), "_kinds": F.transform("tokens", kind)})
    same = {n: F.lit(n).cast("long") for n in (_NAME, _NUMBER, _UNIT)}
    value = lambda k, other: F.when(k == _NUMBER, same[_NUMBER]).when(k == _UNIT, same[_UNIT]).otherwise(other)
    forms = {
        "_names": lambda v, k: value(k, F.when(k == _NAME, same[_NAME]).otherwise(v)),
        "_capitals": lambda v, k: value(k, F.when((k == _NAME) | (k == _FIRST), same[_NAME]).otherwise(v)),
        "_words": lambda v, k: value(k, v),
    }
    return rows.withColumns({name: F.zip_with("_values", "_kinds", form) for name, form in forms.items()})


def _window(form: str, at: Column, size: int) -> Column:
    """Hash of the ``size`` tokens from place ``at`` in a form; null where fewer are left.

    For rows of one place each: Spark compiles it there, which it cannot do with lambdas over arrays.
    """
    return F.when(at + size <= F.size(form), F.xxhash64(*[F.get(form, at + i) for i in range(size)]))


def _words(tokens: Column) -> Column:
    """How many of the tokens are words, not placeholders."""
    return F.size(F.filter(tokens, lambda t: ~_kind(t).isin(NAME, NUMBER, UNIT)))


def item_texts(items: DataFrame, size: int = WINDOW, min_literals: int = MIN_LITERALS) -> DataFrame:
    """item_id, variant, tokens, width, exact and places (starts of windows of that width that count), for each text of an item.

    Where no window of ``size`` has enough words, the whole text is the only window, as long as it is; if
    that has too few words itself, its values must be the same (``exact``).
    """
    rows = items.filter("item_id IS NOT NULL").select("item_id", template_tokens(F.col("text")).alias("tokens")).distinct()
    rows = rows.filter(F.size("tokens") > 0).withColumn("variant", F.xxhash64("tokens"))
    starts = F.when(F.size("tokens") >= size, F.sequence(F.lit(0), F.size("tokens") - size)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("places", F.filter(starts, lambda p: _words(F.slice("tokens", p + 1, F.lit(size))) >= min_literals))
    whole = F.size("places") == 0
    rows = rows.withColumn("exact", whole & (_words(F.col("tokens")) < min_literals))
    rows = rows.withColumn("width", F.when(whole, F.size("tokens")).otherwise(F.lit(size)))
    return rows.withColumn("places", F.when(whole, F.array(F.lit(0))).otherwise(F.col("places")))


def item_windows(texts: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, variant, place, length and window: what is looked for in documents. Of a long exact text its first ``size`` values are."""
    rows = _with_forms(texts).withColumn("length", F.least("width", F.lit(size))).withColumn("place", F.explode("places"))

    def hashed(form: str) -> Column:
        return F.coalesce(*[F.when(F.col("length") == n, _window(form, F.col("place"), n)) for n in range(1, size + 1)])

    forms = F.array(*[hashed(form) for form in _FORMS])
    chosen = F.when(F.col("exact"), F.array(hashed("_values"))).otherwise(forms)
    return rows.select("item_id", "variant", "length", "exact", "place", F.explode(chosen).alias("window")).distinct()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, body (a hash of the text, to tell rows of one id apart) and the text."""
    return docs.select("doc_id", F.xxhash64("text").alias("body"), "text")


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["body"] == b["body"])


def _laid_over(pairs: DataFrame, stages: Stages) -> DataFrame:
    """``pairs`` (tokens and places of an item, theirs: tokens of a document, diagonal) with met: the places of the item that the document has there.

    A number stands for a number, a unit for a unit, a name for any word; another capitalised word for a
    capitalised one, or for any word if it is a name elsewhere in the item. Names must map one to one: of
    contradicting pairs the most frequent counts, in a tie the one that is the same name, then the first.
    Numbers and units must map to one value within a window; several may have become equal.
    """
    word = lambda t: t.isNotNull() & ~_kind(t).isin(NUMBER, UNIT)

    def cell(token: Column, i: Column) -> Column:
        their = F.get("theirs", (i + F.col("diagonal")).cast("int"))
        kind, same = _kind(token), _plain(token) == F.coalesce(_plain(their), F.lit(""))
        named = F.array_contains("tokens", F.concat(F.lit(NAME), _plain(token)))
        fits = (
            F.when(kind.isin(NUMBER, UNIT), _kind(their) == kind)
            .when(kind == NAME, word(their))
            .when(kind == FIRST, word(their) & (same | _kind(their).isin(NAME, FIRST) | named))
            .otherwise(word(their) & same)
        )
        return F.struct(
            i.alias("at"), kind.isin(NAME, FIRST).alias("name"), kind.isin(NUMBER, UNIT).alias("value"), _plain(token).alias("one"), _plain(their).alias("two"),
            same.alias("same"), (F.coalesce(fits, F.lit(False)) & (~F.col("exact") | same)).alias("fits"), (~kind.isin(NAME, NUMBER, UNIT) & same).alias("word"),
        )

    def window(p: Column) -> Column:
        return F.slice("cells", p + 1, F.col("width"))

    # written, and no filters from here on: Spark would work the cells out again for each use
    cells = F.transform("tokens", cell).alias("cells")
    pairs = stages.write("item-cells", pairs.select("doc_id", "body", "item_id", "variant", "total", "start", "places", "width", "exact", "literals", cells))
    pairs = pairs.withColumn("places", F.filter("places", lambda p: F.forall(window(p), lambda c: c["fits"])))
    names = F.filter(
        "cells", lambda c: c["name"] & F.exists("places", lambda p: (p <= c["at"]) & (c["at"] < p + F.col("width")))
    )
    pairs = pairs.withColumn("names", F.transform(names, lambda c: F.struct(c["one"].alias("one"), c["two"].alias("two"))))
    weighed = F.transform(
        F.array_distinct("names"),
        lambda n, i: F.struct(
            n["one"].alias("one"), n["two"].alias("two"), F.struct(F.size(F.filter("names", lambda m: m == n)), n["one"] == n["two"], -i).alias("weight")
        ),
    )
    pairs = pairs.withColumn("weighed", weighed)
    rivals = lambda a, b: ((a["one"] == b["one"]) != (a["two"] == b["two"])) & (a["weight"] < b["weight"])
    wrong = F.filter("weighed", lambda a: F.exists("weighed", lambda b: rivals(a, b)))
    pairs = pairs.withColumn("wrong", F.transform(wrong, lambda a: F.struct(a["one"].alias("one"), a["two"].alias("two"))))

    def counts(p: Column) -> Column:
        cells = window(p)
        values = F.transform(F.filter(cells, lambda c: c["value"]), lambda c: F.struct(c["one"].alias("one"), c["two"].alias("two")))
        one_each = F.size(F.array_distinct(F.transform(values, lambda v: v["one"]))) == F.size(F.array_distinct(values))
        right = (F.size("wrong") == 0) | ~F.exists(cells, lambda c: c["name"] & F.array_contains("wrong", F.struct(c["one"].alias("one"), c["two"].alias("two"))))
        enough = F.col("exact") | (F.size(F.filter(cells, lambda c: c["word"])) >= F.col("literals"))
        return one_each & right & enough

    return pairs.withColumn("met", F.filter("places", counts))


def contaminated(
    docs: DataFrame, items: DataFrame, size: int = WINDOW, min_literals: int = MIN_LITERALS, min_cover: float = MIN_COVER
) -> DataFrame:
    """doc_id, body, item_id, windows, total, cover, first_token: one row for each document and item found in it.

    ``windows`` counts the distinct windows of the item that the document has, see ``_laid_over``;
    ``cover`` is their share of ``total``. Items in which no window has enough words (short ones, lists of
    numbers) are one window as a whole; with too few words in all, only with the same values. One without
    any word is found only where no further number stands beside it, as part of a longer list it is not
    that item. Items without tokens or ids are not searched for. If an id has several texts, the one covered
    best is reported. Documents without text are never found; those without id are, under null. A row
    repeated exactly is reported once. Extra columns of either table are ignored.

    Windows of documents meet those of items in a join that Spark turns into a broadcast only if it
    measures the items as small; otherwise both are shuffled and hot windows are split at run time.
    """
    stages = Stages(docs.sparkSession)
    searched = stages.write("item-texts", item_texts(items, size, min_literals).coalesce(1))
    windows = stages.write("item-windows", item_windows(searched, size).coalesce(1))
    lengths = {(r.length, r.exact) for r in windows.select("length", "exact").distinct().collect()}  # no more than 2 * size
    own = keyed(docs)
    rolled = _with_forms(own.select("doc_id", "body", template_tokens(F.col("text")).alias("tokens")))
    # outer: for plain posexplode Spark adds a filter on the size, in which it works the tokens out once more
    rolled = rolled.select("doc_id", "body", *_FORMS, "_values", F.posexplode_outer("_values").alias("pos", "_value")).drop("_value")
    # a column for each hash first, so that it is worked out once and the compiled method stays small enough for the JVM to compile
    hashed, looked = {}, []
    for length, exact in sorted(lengths):
        forms = ["_values"] if exact else _FORMS
        names = [f"{form}_{length}" for form in forms]
        hashed |= {name: _window(form, F.col("pos"), length) for name, form in zip(names, forms, strict=True)}
        looked.append(F.col(names[0]))
        looked += [F.when(F.col(name) != F.col(names[0]), F.col(name)) for name in names[1:]]  # most windows have no capitals: their forms are one
    rolled = rolled.select("doc_id", "body", "pos", *[window.alias(name) for name, window in hashed.items()])
    rolled = rolled.select("doc_id", "body", "pos", F.explode(F.array(*looked) if looked else F.array().cast("array<bigint>")).alias("window"))
    # on the hash alone, as one long number is looked up fastest: windows of other lengths have other hashes
    hits = rolled.filter("window IS NOT NULL").join(windows.drop("length", "exact"), "window")
    met = hits.select("doc_id", "body", "item_id", "variant", (F.col("pos") - F.col("place")).alias("diagonal")).distinct()
    met = stages.write("item-diagonals", met)

    wanted = stages.write("item-candidates", met.select("doc_id", "body").distinct())
    texts = own.join(wanted, _same_row(own, wanted), "left_semi").dropDuplicates(["doc_id", "body"])
    theirs = texts.select(F.col("doc_id").alias("_d"), F.col("body").alias("_b"), template_tokens(F.col("text")).alias("theirs"))
    pairs = met.join(theirs, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("body") == F.col("_b"))).join(searched, ["item_id", "variant"])
    # only what the item is laid over, with a token on either side
    before = F.greatest(F.col("diagonal") - 1, F.lit(0))
    part = F.slice("theirs", before + 1, F.size("tokens") + 2)
    pairs = pairs.withColumn("theirs", part).withColumn("start", F.col("diagonal")).withColumn("diagonal", F.col("diagonal") - before)
    pairs = pairs.withColumn("literals", F.lit(min_literals)).withColumn("total", F.size("places"))
    beside = [F.get("theirs", (F.col("diagonal") + at).cast("int")) for at in (F.lit(-1), F.size("tokens"))]
    listed = F.forall("tokens", lambda t: _kind(t) == NUMBER)
    pairs = pairs.filter(~listed | ~F.coalesce(_kind(beside[0]) == NUMBER, F.lit(False)) & ~F.coalesce(_kind(beside[1]) == NUMBER, F.lit(False)))
    good = _laid_over(pairs, stages)
    found = good.groupBy("doc_id", "body", "item_id", "variant", "total").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("met")))).alias("windows"),
        F.min(F.try_element_at("met", F.lit(1)) + F.col("start")).alias("first_token"),
    )
    found = found.withColumn("cover", F.col("windows") / F.col("total")).filter((F.col("windows") > 0) & (F.col("cover") >= min_cover))
    best = F.max_by(F.struct("windows", "total", "cover", "first_token"), F.struct("cover", "windows", "variant")).alias("best")
    return found.groupBy("doc_id", "body", "item_id").agg(best).select("doc_id", "body", "item_id", "best.*")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("windows").cast("long").alias("windows"), F.col("total").cast("long").alias("total"), "cover", "first_token")

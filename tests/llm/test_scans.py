"""Scans of single documents and urls, rollups, mixing and the pipeline."""

import random
import re

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shapewright.llm import decontamination, licenses, mixing, pii, toxicity, urls
from shapewright.llm.common import Stages
from shapewright.llm.queries import ORACLES, QUERIES
from shapewright.llm.token_counts import PATTERNS, RepeatedBatch, TokenRollup, bpe_counts, delete, insert, pattern_counts, revise
from shapewright.session import new_folder


def test_license_phrases_equal_brute_force(make, prose):
    texts = [
        "CC-BY, cc by; cc by cc by",
        "All rights\nreserved all rights reserved",
        "GNU General Public License",
        "Licensed under CC BY-NC 4.0. " + prose(1, 30) + " Released under the MIT License.",
        "Licensed under the very Apache License, Version 2.0",
        prose(2, 50),
        "",
        None,
        "ＣＣ by cc by",
    ]
    rows = {r.doc_id: r for r in licenses.scan_licenses(make(texts)).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.license_places(text, licenses.BASE)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert rows[3].labels == "cc-by,cc-by-nc-4.0,mit"
    assert rows[4].labels == "apache-2.0" and rows[4].score < 1  # an inserted word shifts the diagonal by one
    assert rows[5].labels == "" and rows[5].score == 0 and rows[5].spans is None


def test_licenses_of_odd_rows(odd, empty):
    assert licenses.scan_licenses(odd).count() == odd.count()
    assert licenses.scan_licenses(empty).collect() == []


PII = [
    "mail a.b+c@x-y.example.com, b@c.d_e@f.g.h or a@b",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.255 9999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 5500 0000 0000 0004 7",
    "+1 (499) 555-6503 +12 +44 20 7946 0958x +1-2 +999999999999999999",
    "ü𝔘 a@b.co é 1.2.3.4",
    "a" * 3000 + "@" + "b" * 3000 + ".c" * 3000,
    "",
    None,
]


def test_base_spans_equal_brute_force(make):
    rows = {r.doc_id: r for r in pii.find_personal_data(make(PII)).collect()}
    for i, text in enumerate(PII):
        assert [f"{s.kind}:{s.start}:{s.end}" for s in rows[i].base] == brute.personal_data(text)
        assert set(map(tuple, rows[i].base)) <= set(map(tuple, rows[i].spans))


def test_addresses_with_parts_of_zero(make):
    texts = ["10.0.0.1 0.0.0.0 and 1.2.3.000", "127.0.0.1, 192.168.0.1, 8.8.8.8", "00.00.00.00256 0.0.0.256 1.0.0", "0" * 4000 + ".0.0.0"]
    rows = {r.doc_id: r for r in pii.find_personal_data(make(texts)).collect()}
    assert [sum(s.kind == "ip" for s in rows[i].base) for i in range(4)] == [3, 3, 0, 1]
    for i, text in enumerate(texts):
        assert [f"{s.kind}:{s.start}:{s.end}" for s in rows[i].base] == brute.personal_data(text)
    cleaned = pii.find_personal_data(make(texts), keep=("doc_id", "text")).select("doc_id", pii.redact(F.col("text"), F.col("spans")).alias("t"))
    assert {r.doc_id: r.t for r in cleaned.collect()}[1] == "[IP], [IP], [IP]"


def test_contexts_discover_what_the_patterns_miss(make, prose):
    rng = random.Random(1)
    texts = [f"{prose(i, 20)} call me at +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} today {prose(i + 50, 9)}" for i in range(12)]
    texts += [f"{prose(70, 10)} call me at 555-0199 today {prose(71, 10)}", f"{prose(72, 10)} room 555-0198 today"]
    rows = {r.doc_id: r for r in pii.find_personal_data(make(texts)).collect()}
    hidden = texts[12].index("555-0199")
    assert [(s.kind, s.start, s.end) for s in rows[12].spans] == [("phone", hidden, hidden + 8)] and rows[12].base == []
    assert rows[13].spans == []
    out = pii.find_personal_data(make(texts), keep=("doc_id", "text")).select("doc_id", pii.redact(F.col("text"), F.col("spans")).alias("t"))
    cleaned = {r.doc_id: r.t for r in out.collect()}
    assert "me at [PHONE] today" in cleaned[12] and "me at [PHONE] today" in cleaned[0] and cleaned[13] == texts[13]


def test_personal_data_in_odd_rows(odd, empty):
    assert pii.find_personal_data(odd).count() == odd.count()
    assert pii.find_personal_data(empty).collect() == []


def test_no_python_in_native_operators(make):
    for df in (pii.find_personal_data(make(PII)), decontamination.contaminated(make(PII), make(PII).withColumnRenamed("doc_id", "item_id"))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


ITEM = "We say Ann has 3 apples and 2 pears, so Ann sold 5 kg of fruit in all to the man."


def test_changed_numbers_names_and_units_are_found(make, spark, prose):
    texts = [
        prose(1, 40) + " " + ITEM + " " + prose(2, 40),
        "We say Bob has 13 apples and 7 pears, so Bob sold 15 km of fruit in all to the man.",
        "We say Bob has 13 apples and 7 pears, so Carl sold 15 km of fruit in all to the man.",
        prose(3, 200),
        "1 2 3 4 5 6 7 8 9 10 11 12",
        None,
        "",
        "We say Ann has 3 apples",
    ]
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "too short"), (None, ITEM), (4, "1 2 3 4 5 6 7 8 9 10 11")], "item_id long, text string")
    found = decontamination.contaminated(make(texts), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(0, 1), (1, 1)]
    assert all(r.cover > 0.9 for r in found)  # after prose "We" passes for a name


STORY = "Natalia sold clips to 48 of her friends in April. Natalia then sold half as many clips in May. How many clips did Natalia sell to her friends in all?"
SPRING = "In the spring of that year the old farmer, Ann, walked down to the river with Carl, and there they met Tom, who gave them bread."


def found_in(make, spark, texts, *items):
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.cover for r in decontamination.contaminated(make(texts), table).collect()}


def test_items_are_found_in_any_case_and_with_names_anywhere(make, spark, prose):
    renamed = STORY.replace("Natalia", "Weng").replace("48", "72")
    texts = [prose(4, 30).upper() + " " + SPRING.upper(), SPRING.lower(), STORY.upper(), renamed, prose(5, 30) + ". " + renamed, prose(6, 90).upper()]
    cover = found_in(make, spark, texts, SPRING, STORY)
    assert cover == {(0, 0): 1.0, (1, 0): 1.0, (2, 1): 1.0, (3, 1): 1.0, (4, 1): 1.0}


def test_one_contradicting_slot_costs_its_windows_only(make, spark):
    item = "The first box holds 3 red balls and some old paper, while the second box on the shelf holds 3 green balls and 5 small blue stones from the sea."
    texts = [item, item.replace("3 green", "9 green"), item.replace("3", "4").replace("5", "4"), item.replace("3 red", "6 red").replace("3 green", "7 green")]
    cover = found_in(make, spark, texts, item)
    assert set(cover) == {(i, 0) for i in range(4)} and min(cover.values()) == 1.0
    near = "Of the 3 red and 3 green balls that lie in the old box, how many are left on the shelf at the end?"
    cover = found_in(make, spark, [near.replace("3 green", "4 green")], near)
    assert 0.5 <= cover[0, 0] < 1


def test_short_items_and_lists_of_numbers_are_found_as_a_whole(make, spark, prose):
    items = ["What is the capital of Australia?", "12 + 7 = 19", "Compute 3 x 5 - 12 / 4 + 8 - 16 now"]
    texts = [f"{prose(i, 20)}. {item} {prose(i + 9, 20)}" for i, item in enumerate(items)]
    texts += ["What is the capital of the country?", "12 + 8 = 19", "Compute 3 x 5 - 12 / 4 + 8 - 17 now", "see 4 12 + 7 = 19"]
    assert set(found_in(make, spark, texts, *items)) == {(0, 0), (1, 1), (2, 2)}


def test_decontamination_of_odd_rows(odd, empty, spark):
    items = spark.createDataFrame([(9, odd.filter("doc_id = 5").first().text)], "item_id long, text string")
    assert {r.doc_id for r in decontamination.contaminated(odd, items).collect()} == {5, 6}
    assert decontamination.contaminated(empty, items).collect() == []
    assert decontamination.contaminated(odd, items.limit(0)).collect() == []


URLS = ["http://A.Example.com/en/x?q", "https://www.example.com/en/", "http://x.net/fr/1", "http://x.net/en/casino", "http://x.org/free-bets", "http://x.org/freebets",
        "http://x.org/a_win.win", "no scheme /en/", None, "", "ftp://b.org:80?cheap#ADS", "http://example.com", "http://casinos.org/"]


def test_urls(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    scanned = urls.scan_urls(df, "url", keep=("page_id",))
    rejected = {r.page_id: r.rejected for r in scanned.collect()}
    assert [i for i, r in rejected.items() if r] == [3, 4, 10]
    rule, verdict = urls.longest_rule(F.col("host"), F.col("path"))
    parts = df.select("page_id", urls.url_host(F.col("url")).alias("host"), urls.url_path(F.col("url")).alias("path"))
    rows = {r[0]: tuple(r)[1:] for r in parts.select("page_id", "host", "path", rule, verdict).collect()}
    assert rows[0] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert rows[1][2:] == ("www.example.com/en/", "allow") and rows[2][2:] == ("net/fr/", "block")
    assert rows[7] == rows[8] == rows[9] == ("", "", None, None) and rows[11] == ("example.com", "", None, None)
    assert rows[10][:2] == ("b.org:80", "")
    assert urls.scan_urls(df.limit(0), "url").collect() == []


def test_rollup_deltas(spark, make, odd, tmp_path):
    docs = make(["a b c", "d e", None, ""])
    counts = pattern_counts(docs, {"words-1": PATTERNS["words-1"]})
    rollup = TokenRollup(spark, new_folder(spark, "rollup"))
    assert rollup.totals().collect() == [] and rollup.committed() == []
    assert rollup.commit("a", insert(counts)) and not rollup.commit("a", insert(counts))
    more = counts.withColumn("tokens", F.col("tokens") + 1)
    rollup.commit("b", revise(counts.filter("doc_id = 0"), more.filter("doc_id = 0")))
    rollup.commit("c", delete(counts.filter("doc_id = 1")))
    assert {(r.source, r.docs, r.tokens) for r in rollup.totals().collect()} == {("s0", 2, 4), ("s2", 1, 0)}
    # a writer that dies before its batch counts leaves a folder that no total reads
    spark.createDataFrame([("s9", "en", "words-1", 5, 5)], rollup.totals().schema).write.parquet(f"{rollup.folder}/data/dead")
    assert rollup.commit("d", delete(counts.filter("doc_id = 2")))
    assert {(r.source, r.docs) for r in rollup.totals().collect()} == {("s0", 2)}
    assert pattern_counts(odd, PATTERNS).count() == 2 * odd.count()


def test_rollup_of_two_writers_and_repeated_ids(spark, make, tmp_path, monkeypatch):
    counts = pattern_counts(make(["a b c", "d e"]), {"words-1": PATTERNS["words-1"]})
    one, two = (TokenRollup(spark, f"{tmp_path}/r") for _ in range(2))
    create = TokenRollup._create

    def meet(self, name, record):  # the second writer commits the same batch just before the first one does
        if self is one and name.startswith("batches"):
            monkeypatch.setattr(TokenRollup, "_create", create)
            assert two.commit("../x/ä", insert(counts))
        return create(self, name, record)

    monkeypatch.setattr(TokenRollup, "_create", meet)
    assert not one.commit("../x/ä", insert(counts))
    assert one.committed() == ["../x/ä"] and {p.name for p in tmp_path.iterdir()} == {"r"}
    with pytest.raises(RepeatedBatch):
        one.commit("../x/ä", insert(counts.filter("doc_id = 0")))
    assert sorted((r.source, r.docs, r.tokens) for r in two.totals().collect()) == [("s0", 1, 3), ("s1", 1, 2)]


def test_rollup_compaction(spark, make, empty, odd, tmp_path):
    counts = pattern_counts(make(["a b c", "d e"]), PATTERNS)
    rollup = TokenRollup(spark, f"{tmp_path}/r")
    wide = pattern_counts(odd, {"words-1": PATTERNS["words-1"]})
    for batch, changes in (("1", insert(counts)), ("2", insert(wide)), ("3", insert(pattern_counts(empty, PATTERNS)))):
        rollup.commit(batch, changes)
    before = sorted(map(repr, rollup.totals().collect()))
    assert rollup.compact() and sorted(map(repr, rollup.totals().collect())) == before
    assert len(rollup.totals().inputFiles()) == 1
    assert not rollup.commit("2", insert(wide)) and rollup.commit("4", delete(wide)) and rollup.compact()
    assert {(r.source, r.docs) for r in rollup.totals().collect()} == {("s0", 1), ("s1", 1)}


def test_byte_pairs_count_like_the_encoding(make, tmp_path):
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257}
    file = tmp_path / "ranks.tiktoken"
    file.write_text("".join(f"{base64.b64encode(k).decode()} {v}\n" for k, v in ranks.items()))
    encoding = tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    texts = ["abc ab cab", "é", "", None]
    got = {r.doc_id: r.tokens for r in bpe_counts(make(texts), str(file), r"\S+|\s+", "t").collect()}
    assert got == {i: len(encoding.encode(t or "")) for i, t in enumerate(texts)}


def test_mixing_meets_its_targets(make, prose, odd, empty):
    texts = [prose(i, random.Random(i).randrange(5, 60)) for i in range(150)] + [None, "", (None, prose(3, 10))]
    docs = make(texts)
    rows = mixing.mix(docs).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs.repartition(3)).collect()))
    total = sum(r.size for r in rows)
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
        assert 0 <= r.copies <= 2
    assert abs(sum(v[0].target for v in by_source.values()) - 1.5 * total) < 1e-6
    for group in by_source.values():
        size, target = group[0].source_size, group[0].target
        assert size == sum(r.size for r in group) and target <= 2 * size + 1e-9
        assert abs(sum(r.size * r.copies for r in group) - target) <= max(r.size for r in group) / 2 + 1e-6
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).collect() == []


def test_water_filling_rounds(spark):
    sizes = spark.createDataFrame([("a", 10, 5), ("b", 100, 2), ("c", 100, 1), ("d", 0, 5)], "source string, source_size long, weight long")
    got = {r.source: r.target for r in mixing.water_fill(sizes).collect()}
    assert got == {"a": 20.0, "b": 295 * 2 / 3, "c": 295 / 3, "d": 0.0} or got == {"a": 20.0, "b": 590 / 3, "c": 295 / 3, "d": 0.0}
    with pytest.raises(ValueError):
        mixing.water_fill(sizes, share=3)


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.op6_toxicity(spark, folder).filter("held_out").join(labels, "doc_id").collect()
    caught = [r.predicted for r in rows if r.toxic]
    assert sum(caught) >= 0.75 * len(caught)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.01 * len(rows)


def test_toxicity_of_odd_rows(spark, odd, empty, make):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(3, 1), (3, None), (None, 1), (5, 0), (8, 0), (99, 1)], "doc_id long, toxic int")):
        scored = toxicity.toxic_scores(odd, toxicity.train(odd, labels)).collect()
        assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert all(r.predicted == 0 for r in toxicity.toxic_scores(odd, toxicity.train(odd, none)).collect())
    assert toxicity.toxic_scores(empty, toxicity.train(empty, none)).collect() == []


@pytest.fixture
def tables(spark, prose, tmp_path):
    def write(docs):
        folder = str(tmp_path / "tables")
        docs.write.parquet(f"{folder}/documents.parquet")
        labels = [(i, 0, int(i % 10 == 0)) for i in range(200)]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        return folder

    return write


def test_mixing_copies_no_document_more_often_than_allowed(make):
    """Documents without words come before the cut; they do not get a copy above the limit."""
    rows = mixing.mix(make([(3 * i, "a b c" if i % 3 == 0 else "") for i in range(60)] + [(3 * i + 1, "a " * 500) for i in range(60)])).collect()
    assert max(r.copies for r in rows) == 2 and {r.copies for r in rows if r.source == "s0"} == {2}


def test_run_of_the_pipeline(spark, make, prose, tables):
    """run() gives what the stages give, and leaves only its result behind."""
    folder = tables(make([prose(i, 60) for i in range(60)] + [prose(5, 60), prose(6, 60) + " x", None, ""]))
    want = sorted(map(repr, staged(spark, folder)[-1].collect()))
    Stages.release()
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(repr, got.collect())) == want
    assert sum(len(s.folders) for s in Stages.written) == 1


def staged(spark, folder):
    stages, docs, seen = Stages(spark), spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES:
        docs = stages.write(name, function(spark, docs, folder))
        seen.append(docs)
    return seen


def test_pipeline_takes_its_decisions(spark, make, prose, tables):
    texts = [prose(i, 60) + (" moron idiot scum" if i % 10 == 0 else "") for i in range(200)]
    texts += [texts[1], texts[1] + " more", prose(300, 20) + " " + ITEM, prose(301, 20) + " a@b.example.com " + prose(302, 20), "", None]
    toxic, single, clean, redacted, mixed = staged(spark, tables(make(texts)))
    assert {r.doc_id for r in toxic.collect()} == {i for i in range(206) if not (i < 200 and i % 10 == 0)}
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in toxic.collect()} - {200, 201}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - {202}
    rows = {r.doc_id: r for r in redacted.collect()}
    assert set(rows) == {r.doc_id for r in clean.collect()}
    assert "[EMAIL]" in rows[203].text and rows[203].n_chars == len(rows[203].text) and rows[1].text == texts[1] and rows[205].text is None
    words = sum(len((t.text or "").split()) for t in redacted.collect())
    assert abs(sum(len((r.text or "").split()) for r in mixed.collect()) - 1.5 * words) < 0.02 * words
    assert all(d.columns == toxic.columns for d in (single, clean, redacted))


def test_pipeline_on_odd_rows_and_without_rows(spark, odd, empty, tables, tmp_path):
    for docs in (odd, empty):
        folder = tables(docs) if docs is odd else str(tmp_path / "none")
        if docs is empty:
            docs.write.parquet(f"{folder}/documents.parquet")
            spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
            spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        seen = staged(spark, folder)
        assert all(d.columns == docs.columns for d in seen[:-1])
        assert seen[-1].columns[: len(docs.columns)] == docs.columns
    assert seen[-1].count() == 0


def test_registered_names():
    assert {re.match(r"op(\d+)_", n).group(1) for n in QUERIES} == {str(n) for n in range(1, 14)}
    assert set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "decontamination", "pii", "mixing"]

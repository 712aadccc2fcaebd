"""Jaccard join, substring dedup and fingerprints against brute force."""

import hashlib
import random

import brute
import numpy as np
import pyarrow as pa

from shapewright.llm import fingerprints, jaccard, substrings
from shapewright.llm.words import ALNUM, FOLD, NOT_SPACE, words_of


def near_copies(prose, words, n=60, groups=6, size=120, seed=5):
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        base = prose(100 + g, size).split()
        for _ in range(n // groups):
            own = list(base)
            for _ in range(rng.randrange(8)):
                own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.3:
                own = own[: rng.randrange(60, len(own))]
            texts.append(" ".join(own))
    return texts + [prose(900 + i, 90) for i in range(20)]


def test_words_match_the_patterns():
    texts = ["Hello, Wörld 42!", None, "", "  a\tb\x0bc\x1cd ", "ÀB-c_d", "x"]
    for fold, kind, pattern in ((True, ALNUM, brute.ALNUM), (False, NOT_SPACE, brute.SPACE), (True, NOT_SPACE, brute.SPACE)):
        found = words_of(pa.array(texts), fold, kind)
        want = [pattern.findall((t or "").translate(brute.LOW) if fold else t or "") for t in texts]
        assert list(found.counts) == [len(w) for w in want]
        got = [found.data[s:e].tobytes().decode() for s, e in zip(found.start, found.end, strict=True)]
        assert got == sum(want, [])
        by_word = {}
        for word, value in zip(got, found.hashes(), strict=True):
            assert by_word.setdefault(word, value) == value
        assert len(set(by_word.values())) == len(by_word)
    assert FOLD[ord("Q")] == ord("q")


def test_classes_equal_brute_force(make, prose, words):
    texts = near_copies(prose, words) + ["", None, "a b", "A b", "a b c d e", "A B C D E"]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_classes(make(texts)).collect()}
    assert got == brute.classes(rows)


def test_classes_with_the_last_comparison_only(make, prose, words):
    """With no pivot rounds every pair left in a cell is compared, with the same result."""
    texts = near_copies(prose, words, 24, 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_classes(make(texts), rounds=1).collect()}
    assert got == brute.classes(list(enumerate(texts)))


def test_a_hub_keeps_its_variants_across_a_border_of_sizes(make, prose):
    """101 and 99 shingles are in neighbouring bands; variants link to the original only, not to each other."""
    hub, rng = prose(41, 105).split(), random.Random(9)
    texts = [" ".join(hub)]
    for i in range(30):
        own, at = list(hub[:103]), rng.randrange(5, 45)
        own[at], own[at + rng.randrange(8, 50)] = f"x{i}", f"y{i}"
        texts.append(" ".join(own))
    want = brute.classes(list(enumerate(texts)))
    assert {c for _, c in want.values()} == {0} and {n for n, _ in want.values()} == {99, 101}
    for rounds in (0, jaccard.ROUNDS):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_classes(make(texts), rounds=rounds).collect()} == want


def test_classes_of_odd_rows(odd, empty):
    rows = jaccard.link_classes(odd).collect()
    assert len(rows) == odd.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert by_id[5] == by_id[6] and next(iter(by_id[6]))[1] == 5
    assert by_id[7] == {(next(iter(by_id[7]))[0], 7)} and next(iter(by_id[8]))[1] == 7
    assert by_id[1] == {(0, 1)} and by_id[0] == {(0, 0)} and by_id[3] == {(1, 3)}
    assert {c for _, c in by_id[None]} == {None}
    assert jaccard.link_classes(empty).collect() == []


def shingles_of(texts):
    """The hashes of every text's set, equal sets once."""
    row, value = jaccard.shingle_sets(pa.array(texts))
    return np.concatenate([np.array(x, dtype=np.uint64) for x in {tuple(value[row == i]) for i in range(len(texts))}])


def test_frequencies_are_those_of_all_sets(make, prose, monkeypatch):
    """Counted in several parts a task and in slices, as numpy counts them in one."""
    monkeypatch.setattr(jaccard, "HELD", 100)
    passage = prose(7, 30)
    texts = [f"{passage} {prose(300 + i, 20)}" for i in range(40)] + [prose(600 + i, 40) for i in range(20)] + ["", None]
    bits = 9
    counts = jaccard.sets(make(texts), bits).filter("slice IS NOT NULL")
    got = {(r.code, r.level) for r in jaccard.frequent_shingles(counts).collect()}
    code, times = np.unique(shingles_of(texts) >> np.uint64(32 - bits), return_counts=True)
    many = times >= jaccard.FREQUENT
    assert many.sum() == 26
    assert got == {(int(c), int(np.log2(t))) for c, t in zip(code[many], times[many], strict=True)}


def test_the_list_keeps_the_highest_levels(spark, monkeypatch):
    rows = spark.createDataFrame([(9, 4), (2, 6), (5, 4), (7, 5)], "code long, level int")
    assert [(int(x) >> 6, int(x) & 63) for x in jaccard.frequency_list(rows)] == [(2, 6), (5, 4), (7, 5), (9, 4)]
    monkeypatch.setattr(jaccard, "LISTED", 3)
    assert [(int(x) >> 6, int(x) & 63) for x in jaccard.frequency_list(rows)] == [(2, 6), (7, 5)]
    assert len(jaccard.frequency_list(rows.limit(0))) == 0


def test_twice_the_corpus_has_twice_the_shared_places(make, prose):
    """Passages that many documents share do not fill cells, however many other shingles there are."""

    def shared(texts):
        docs = make(texts)
        counts = jaccard.sets(docs, 9).filter("slice IS NOT NULL")
        listed = jaccard.frequency_list(jaccard.frequent_shingles(counts))
        return jaccard.shared_cells(jaccard.postings(docs, listed, 9)).count()

    def corpus(tag, n=60):
        passage = " ".join(f"{tag}p{i}" for i in range(30))
        own = [" ".join(f"{tag}w{i}x{j}" for j in range(120)) for i in range(n)]
        return [f"{own[i]} {passage}" for i in range(n)] + [own[i].replace("x5 ", "y5 ") + " " + passage for i in range(10)]

    one = shared(corpus("a"))
    assert 0 < one < 10 * 2 * 34 + 10
    assert shared(corpus("a") + corpus("b")) <= 2.2 * one


def test_a_large_group_of_near_copies_costs_one_comparison_each(make, prose, words, monkeypatch):
    base, rng = prose(7, 100).split(), random.Random(3)
    texts = []
    for _ in range(150):
        own = list(base)
        own[rng.randrange(100)] = rng.choice(words) + "q"
        texts.append(" ".join(own))
    compared = []
    write = jaccard.Stages.write

    def counted(self, name, df, **more):
        out = write(self, name, df, **more)
        if name.startswith("pairs"):
            compared.append(out.count())
        return out

    monkeypatch.setattr(jaccard.Stages, "write", counted)
    assert {r.component_id for r in jaccard.link_classes(make(texts)).collect()} == {0}
    assert sum(compared) < 150 * 12


def test_pairs_of_near_copies_move_once(make, prose, monkeypatch):
    """Two sets that share many cells are one row after the cells, and no text without a pair is moved to be compared."""
    texts = [f"{prose(i, 80)} q{i}{c}" for i in range(20) for c in "ab"] + [prose(700 + i, 80) for i in range(30)]
    written = {}
    write, perhaps = jaccard.Stages.write, jaccard._perhaps

    def counted(self, name, df, **more):
        written[name] = (out := write(self, name, df, **more)).count()
        return out

    def passed(rows, key, chosen, other):
        written[key] = (out := perhaps(rows, key, chosen, other)).count()
        return out

    monkeypatch.setattr(jaccard.Stages, "write", counted)
    monkeypatch.setattr(jaccard, "_perhaps", passed)
    got = {r.doc_id: r.component_id for r in jaccard.link_classes(make(texts)).collect()}
    assert got == {i: c for i, (_, c) in brute.classes(list(enumerate(texts))).items()}
    assert [written[x] for x in ("cells", "able-0", "pairs-0", "texts", "body", "xxhash64(sid)")] == [20, 0, 20, 40, 40, 40]


def test_cells_of_any_size_over_batches(spark):
    """Small cells yield pairs, larger ones members, wherever batches end; repeated sets count once."""
    sizes = [1, 2, 3, jaccard.LEAF, jaccard.LEAF + 1, 2, 40, 1, jaccard.LEAF]
    rows = [(c, None, bytes([i]) * 16, 100, 90 + i % 3, i % 2 == 0, False) for c, m in enumerate(sizes) for i in range(m)]
    rows += [r for r in rows if r[0] in (0, 2, 4, 6)] * 3
    rows += [(1000 + i, 99, bytes([i]) * 16, 100, 90, True, True) for i in range(3)]
    places = spark.createDataFrame(rows, jaccard._PLACES)
    pairs = {(bytes([i]) * 16, bytes([j]) * 16) for m in sizes if m <= jaccard.LEAF for i in range(m) for j in range(i + 1, m) if i % 2 == 0 or j % 2 == 0}
    members = {(c, bytes([i]) * 16) for c, m in enumerate(sizes) if m > jaccard.LEAF for i in range(m)} | {(99, bytes([i]) * 16) for i in range(3)}
    for size in (1, 3, 7, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        try:
            got = jaccard.shared_cells(places.repartition(3)).distinct().collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {(bytes(r.sid), bytes(r.other)) for r in got if r.other is not None} == pairs
        assert sorted((r.cell, bytes(r.sid)) for r in got if r.other is None) == sorted(members)
        assert all(r.n == (100 if r.other is None else 200) for r in got)


def test_a_full_map_leaves_no_chosen_row_out(spark, monkeypatch):
    rows, chosen = spark.range(1000).selectExpr("xxhash64(id) AS k"), spark.range(0, 1000, 10).selectExpr("xxhash64(id) AS o")
    want = {r.o for r in chosen.collect()}
    assert {r.k for r in jaccard._perhaps(rows, "k", chosen, "o").collect()} == want
    monkeypatch.setattr(jaccard, "MARKS", 64)
    assert {r.k for r in jaccard._perhaps(rows, "k", chosen, "o").collect()} >= want


def test_removed_windows_equal_brute_force(make, prose):
    passage = prose(50, 70)
    texts = [prose(i, 60) + " " + passage + " " + prose(i + 500, 40) for i in range(8)]
    texts += [passage + " " + passage, " ".join(passage.split()[:20]), " ".join(passage.split()[3:22]), "", None, "w " * 45, prose(3, 60)]
    got = {
        r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest())
        for r in substrings.remove_copies(make(texts)).collect()
    }
    assert got == brute.kept_words(list(enumerate(texts)))


def test_every_pair_of_places_shares_a_shift():
    for i in range(substrings.PERIOD):
        for j in range(substrings.PERIOD):
            assert any((i + d) % 13 in substrings.COVER and (j + d) % 13 in substrings.COVER for d in range(13))


def test_removal_over_batches_and_odd_rows(spark, odd, empty):
    rows = substrings.remove_copies(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.n_removed == 0 for r in rows if r.doc_id == 5)  # repeated rows are one document
    assert all(r.n_removed == r.n_words for r in rows if r.doc_id == 6)
    assert all(r.n_removed == 0 and r.kept_text == "" for r in rows if r.doc_id in (0, 1, 2))
    assert substrings.remove_copies(empty).collect() == []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        again = substrings.remove_copies(odd).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_fingerprints_follow_the_contract(make, prose):
    texts = [prose(i, 40 + i) for i in range(25)] + ["", None, "a", "ab", prose(3, 43), "é" * 9 + " 𝔘𝔫𝔦"]
    rows = {r.doc_id: r for r in fingerprints.compare_with_next(make(texts)).collect()}
    plain = [t or "" for t in texts]
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(make(texts)).collect()}
    for i, text in enumerate(plain):
        following = plain[i - 1]
        r = rows[i]
        assert (r.n_chars, r.edited_text) == (len(text), brute.edited(text, following))
        assert r.fingerprint == prints[i] and len(r.fingerprint) == fingerprints.M * fingerprints.DIGITS
        assert (r.near_next == 1.0) if text == following else (r.near_next < 1.0)
        assert 0 <= r.near_edited <= 1
    assert prints[3] == prints[29] and prints[25] == prints[26] and len(set(prints.values())) == len(set(plain))
    assert np.mean([r.near_edited for r in rows.values()]) > np.mean([r.near_next for r in rows.values()])


def test_fingerprints_see_order(prose):
    """The same words in another order are less alike than a text with a few words changed."""
    own = prose(1, 300).split()
    halves = own[150:] + own[:150]
    touched = own[:140] + ["zz"] * 5 + own[145:]
    one, two, three = fingerprints.signatures(pa.array([" ".join(own), " ".join(touched), " ".join(halves)]))
    assert (one == two).mean() > (one == three).mean() > 0


def test_likeness_and_odd_rows(spark, odd, empty):
    from pyspark.sql import functions as F

    a = fingerprints.fingerprints(odd.filter("doc_id IN (7, 8)"))
    x, y = (r.fingerprint for r in a.collect())
    got = spark.createDataFrame([(x, y)], "x string, y string").select(fingerprints.likeness(F.col("x"), F.col("y"))).first()[0]
    assert got == np.mean([x[i : i + 8] == y[i : i + 8] for i in range(0, len(x), 8)])
    assert fingerprints.compare_with_next(odd).count() == odd.count()
    assert fingerprints.compare_with_next(empty).collect() == []
    single = fingerprints.compare_with_next(odd.filter("doc_id = 3")).collect()
    assert len(single) == 1 and single[0].near_next == 1.0

"""Merkle manifest, shards and hard negatives against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shapewright.llm import hard_negatives, merkle, sharding
from shapewright.llm.hard_negatives import mine, op13_hard_negatives
from shapewright.llm.merkle import digest, manifest, op11_merkle, verify
from shapewright.llm.sharding import Tree, descend, op12_sharding, place, write_shards

# --- Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lower_az(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(nodes):
    """What remains of the nodes, and for each the lists of siblings (before, after), level by level."""
    paths, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [list(range(i, min(i + 8, len(nodes)))) for i in range(0, len(nodes), 8)]
        for run in runs:
            for at in run:
                before, after = "".join(nodes[i] for i in run if i < at), "".join(nodes[i] for i in run if i > at)
                for leaf in members[at]:
                    paths[leaf].append((before, after))
        members = [[leaf for i in run for leaf in members[i]] for run in runs]
        nodes = [sha(*[nodes[i] for i in run]) for run in runs]
    return nodes[0] if nodes else None, paths


def brute_merkle(docs):
    """doc_id, leaf, subroot, root, proof, folded root and whether it is the root, for (doc_id, text, lang, source, n_chars)."""
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in docs:
        make = lambda t: sha(*map(enc, (doc_id, source, lang, n_chars, t)))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        groups[lang].append((doc_id, make(text), make(lower_az(text)) if hit else make(text)))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[lang] = climb([leaf for _, leaf, _ in groups[lang]])
    root, above = climb([trees[g][0] for g in langs])
    out = []
    for lang, upper in zip(langs, above):
        subroot, paths = trees[lang]
        for (doc_id, leaf, held), path in zip(groups[lang], paths):
            for before, after in path + upper:
                held = sha(before, held, after)
            proof = sha(*[b + a for b, a in path + upper])
            out.append((doc_id, leaf, subroot, root, proof, held, held == root))
    return out


MERKLE = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def as_table(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def plain_docs(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_merkle_of_odd_rows(spark, odd, tmp_path):
    got = [tuple(r) for r in op11_merkle(spark, as_table(odd, tmp_path, "documents")).select(*MERKLE).collect()]
    assert Counter(got) == Counter(brute_merkle(plain_docs(odd)))


@pytest.mark.parametrize("sizes", [(1,), (8, 1), (9, 64), (65, 2, 130)])
def test_merkle_of_runs_and_levels(spark, tmp_path, sizes):
    docs = [(f * 1000 + i, f"Text {i} Ä", f"g{f}", None, i) for f, n in enumerate(sizes) for i in range(n)]
    random.Random(5).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = {tuple(r) for r in op11_merkle(spark, as_table(df, tmp_path, "documents")).select(*MERKLE).collect()}
    assert got == set(brute_merkle(docs)) and len(got) == len(docs)


def test_merkle_finds_what_was_changed(spark, make):
    docs = make([f"Document {i}" for i in range(100)])
    changed = {3, 64, 99}
    carry = {"held": merkle.row_digest({c: F.col(c) for c in merkle.COLUMNS[:-1]} | {"text": F.when(F.col("doc_id").isin(*changed), F.lit("x")).otherwise(F.col("text"))})}
    rows = verify(manifest(docs, carry=carry), "held").collect()
    assert {r["doc_id"] for r in rows if not r["verified"]} == changed


def test_merkle_of_nothing(spark, empty, tmp_path):
    assert op11_merkle(spark, as_table(empty, tmp_path, "documents")).collect() == []


def test_digest_is_of_the_parts_together(spark):
    assert spark.range(1).select(digest(F.lit("ab"), F.lit("c"))).first()[0] == sha("abc")


# --- shards


def draw(key, tree):
    chosen = ""
    for level, nodes in zip(sharding.LEVELS, tree.children()):
        score = lambda n: -math.log((int(hashlib.md5(f"{sharding.SEED}/{level}/{n}/{key}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13)
        chosen = min((score(n) / w, n) for n, w in nodes[chosen].items())[1]
    return int(chosen)


def brute_shards(docs, tree, grown):
    rows = []
    for doc_id, text in docs:
        data, key = (text or "").encode(), "-" if doc_id is None else str(doc_id)
        rows.append((draw(key, tree), doc_id is not None, doc_id or 0, zlib.crc32(data), len(data) + 16, draw(key, grown)))
    rows.sort()
    slots = Counter()
    out = []
    for shard, known, doc_id, crc, size, then in rows:
        out.append((doc_id if known else None, size, crc, "key", shard, slots[shard], then))
        slots[shard] += 1
    return out


SHARDS = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def test_shards_of_odd_rows(spark, odd, tmp_path):
    got = [tuple(r) for r in op12_sharding(spark, as_table(odd, tmp_path, "documents")).select(*SHARDS).collect()]
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert Counter(got) == Counter(brute_shards(docs, sharding.PRODUCTION, sharding.PRODUCTION.grown()))


def test_shards_of_the_given_documents(spark, small):
    got = [tuple(r) for r in op12_sharding(spark, small).select(*SHARDS).collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(got) == sorted(brute_shards(docs, sharding.PRODUCTION, sharding.PRODUCTION.grown()))


def keys(spark, tree, n=4000):
    at = descend(F.col("id").cast("string"), tree)
    return {r["id"]: (r["region"], r["rack"], r["shard"]) for r in spark.range(n).select("id", at.alias("at")).select("id", "at.*").collect()}


def test_every_further_shard_takes_rows_only_into_itself(spark):
    tree = Tree.regular(2, 2, 3)
    before = keys(spark, tree)
    for _ in range(4):
        tree = tree.grown()
        after, new = keys(spark, tree), max(tree.shards)
        moved = {k for k in before if before[k] != after[k]}
        assert moved and all(after[k][2] == new for k in moved)
        assert abs(len(moved) - 4000 / len(tree.shards)) < 6 * math.sqrt(4000 / len(tree.shards))
        before = after


def test_movement_is_confined_to_subtrees_whose_weights_change(spark):
    tree = Tree.regular(3, 2, 2)
    before, after = keys(spark, tree), keys(spark, tree.with_weight(5, 3.0))
    region, rack, _ = tree.shards[5]
    for k, (old, new) in {k: (before[k], after[k]) for k in before if before[k] != after[k]}.items():
        if old[0] != new[0]:
            assert new[0] == region
        elif old[1] != new[1]:
            assert new[:2] == (region, rack)
        else:
            assert new == (region, rack, 5)
    lighter = keys(spark, tree.with_weight(5, 0.25))
    assert all(before[k][0] == region for k in before if before[k] != lighter[k])


def test_shares_follow_weights(spark):
    tree = Tree({0: ("a", "a1", 1.0), 1: ("a", "a1", 2.0), 2: ("b", "b1", 5.0)})
    held = Counter(at[2] for at in keys(spark, tree, 8000).values())
    assert all(abs(held[s] - 1000 * w) < 6 * math.sqrt(1000 * w) for s, w in ((0, 1), (1, 2), (2, 5)))
    with pytest.raises(ValueError):
        Tree({0: ("a", "a1", 0.0)})


def test_written_shards_hold_the_rows(spark, odd, tmp_path, rows):
    tree = Tree.regular(2, 1, 3)
    docs = odd.select("doc_id", "text", "order", "key")
    write_shards(docs, tree, f"{tmp_path}/out", rows_per_file=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert rows(back.select(*docs.columns)) == rows(docs)
    at = place(odd, tree).select("doc_id", "shard").distinct()
    assert rows(back.select("doc_id", "at_shard").distinct()) == rows(at)


def test_no_rows_no_shards(spark, empty, tmp_path):
    assert op12_sharding(spark, as_table(empty, tmp_path, "documents")).collect() == []


# --- hard negatives


def brute_negatives(rows):
    """rows: (vec_id, embedding, label)."""
    kept = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        q = [math.floor(256 * x) for x in vector]
        kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, q))
    out = []
    for i, (anchor, label, q) in enumerate(kept):
        if anchor % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, r)), v, lab) for j, (v, lab, r) in enumerate(kept) if j != i)
        for ps, positive, _ in [s for s in scored if s[2] == label][:5]:
            hard = [s for s in scored if s[2] != label and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:5]
            out += [(anchor, positive, rank, v, -ps, -ns) for rank, (ns, v, _) in enumerate(hard, 1)]
    return out


def vectors(seed, n, dim=6, labels=3, spread=1.0):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    made = []
    for i in range(n):
        c = rnd.choice(centres)
        made.append((i, [round(x + rnd.gauss(0, spread), 2) for x in c], rnd.randrange(labels)))
    return made


def check_negatives(spark, rows, folder):
    rows = [(i, v and [x if x is None else float(x) for x in v], label) for i, v, label in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    held = [(r[0], r[1], r[2]) for r in df.collect()]
    got = [tuple(r) for r in op13_hard_negatives(spark, as_table(df, folder, "embeddings")).collect()]
    assert Counter(got) == Counter(brute_negatives(held))
    return got


def test_hard_negatives_of_odd_rows(spark, tmp_path):
    rows = vectors(1, 320)
    rows += [(1000, None, 1), (1100, [0.5, None, 0, 0, 0, 0], 1), (1200, [float("nan")] * 6, 1), (1300, [float("inf")] * 6, 1)]
    rows += [(1400, [0.5, 0.25], 1), (1500, [], 2), (1600, [0.0] * 6, 2), (1700, [1.0] * 9, 0), (None, [1.0] * 6, 0), (1800, [1.0] * 6, None)]
    rows += [(2000, [0.5] * 6, 1)] * 3 + [(2001, [0.5] * 6, 0)] * 4  # repeated rows, the anchor too
    assert check_negatives(spark, rows, tmp_path)


def test_hard_negatives_with_ties_and_copies(spark, tmp_path):
    rows = [(i, [float(i % 3), 1.0], i % 2) for i in range(150)] + [(200 + i, [2.0, 1.0], 1) for i in range(120)]
    assert check_negatives(spark, rows, tmp_path)


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_hard_negatives_in_many_passes_turns_and_lists(spark, tmp_path, monkeypatch, spread):
    monkeypatch.setattr(hard_negatives, "PASS_BYTES", 8 * 6 * 5)
    monkeypatch.setattr(hard_negatives, "MEMBERS", 2)
    monkeypatch.setattr(hard_negatives, "STEP", 16)
    monkeypatch.setattr(hard_negatives, "TASKS", 0.05)
    monkeypatch.setattr(hard_negatives, "SHARE", 3)
    assert check_negatives(spark, vectors(7, 1101, spread=spread), tmp_path)


def test_lists_end_early_for_clustered_vectors(spark, monkeypatch):
    """With directions that fall into cells, most of a list is below what its members need."""
    import numpy as np

    rnd = np.random.default_rng(3)
    centres = np.eye(8) * 1000
    matrix = np.floor(np.repeat(centres, 500, axis=0) + rnd.normal(0, 20, (4000, 8)))
    unit, norm = hard_negatives._directions(matrix)
    anchors = {"rid": np.arange(4000), "label": np.zeros(4000, int), "matrix": matrix, "low": np.full((4000, 1), -hard_negatives.BEYOND), "high": np.full((4000, 1), hard_negatives.BEYOND)}
    block = hard_negatives._Block(np.arange(0, 500, 100), anchors, unit[0])
    cand = {"rid": np.arange(4000), "id": np.arange(4000), "label": np.zeros(4000, int), "matrix": matrix, "norm": norm}
    scored = []
    monkeypatch.setattr(hard_negatives, "STEP", 50)
    merge = hard_negatives._Block._merge
    monkeypatch.setattr(hard_negatives._Block, "_merge", lambda self, *a: (scored.append(1), merge(self, *a)))
    block.walk(cand, unit, True, 5, True)
    assert len(scored) <= 11  # of 80 steps; the cell of the anchors has 10
    for i, a in enumerate(range(0, 500, 100)):
        want = sorted((-int(matrix[a] @ matrix[c]), c) for c in range(4000) if c != a)[:5]
        assert [(-s, c) for s, c in zip(block.score[block.row == i], block.ident[block.row == i])] == want


def test_large_components_need_whole_numbers(spark):
    """Scores above 2**53 are exact, and rows whose scores would leave a long take no part."""
    rows = [(0, 1, [2.0**29, 3.0], True), (1, 1, [2.0**29, 1.0], False), (2, 1, [2.0**29 - 1, 9.0], False), (3, 2, [2.0**29 - 2, 0.0], False), (5, 2, [2.0**29 - 1, 10.0], False)]
    df = spark.createDataFrame([*rows, (4, 2, [1e30, 1e30], False)], "id long, label long, vector array<double>, anchor boolean")
    got = {tuple(r) for r in mine(df).collect()}
    score = lambda q: 2**29 * q[0] + 3 * q[1]
    low, near = (3, int(score((2**29 - 2, 0)))), (5, int(score((2**29 - 1, 10))))  # the second is 3 above the positive with 9
    ones, nines = int(score((2**29, 1))), int(score((2**29 - 1, 9)))
    assert got == {(0, 1, 1, near[0], ones, near[1]), (0, 1, 2, low[0], ones, low[1]), (0, 2, 1, low[0], nines, low[1])}


def test_no_vectors_no_negatives(spark, tmp_path):
    assert check_negatives(spark, [], tmp_path) == []
    assert check_negatives(spark, [(1, [1.0], 1), (2, [1.0], 2)], tmp_path) == []

"""Jaccard metric-space join of word shingles, to classes of linked documents.

Distance is 1 - J, a metric; documents link at distance ``EPS`` or less. Random pivots alone cannot split
a corpus: documents that share nothing with a pivot are at distance 1 from it, and windows of the
triangle inequality would copy all of them everywhere. So regions start as cells of documents that share
one of their rarest shingles (two linked documents always do), and within a cell:

* a cell with few members is compared pair by pair at once, where what can still be shared allows a link. In others
  a pivot is chosen and met by every member: sketches bound the distance from below, a short one that
  every member carries, then one that grows with the set, and where they leave a link possible the whole texts are compared. Members within EPS link to the pivot;
* they are one region, the others the next. By the triangle inequality a link from the first ends within
  twice EPS of the pivot, so others that may be there are copied to it (the window);
* a region whose members are already in one class is finished, one with few members is compared pair by
  pair, where sizes and what can still be shared allow a link. The others choose a pivot again.

What is left after ``ROUNDS`` is compared pair by pair, too. So classes are exact, while a group of near copies costs one comparison a member, not one a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapewright.llm.common import Stages, chunks, table
from shapewright.llm.words import NOT_SPACE, U, mix, windows, words_of

SHINGLE = 5
NEAR, OF = 3, 4  # a link needs NEAR / OF of the union in common
EPS = 1 - NEAR / OF
ROUNDS = 3
CORNERS, FILL = 256, 12  # fewest classes of shingles that a sketch counts, and most shingles a class has on average
LEAF = 8  # cells and regions with no more members are compared pair by pair
FREQUENT = 16  # a shingle seen this often is listed as frequent
LISTED = 4 << 20  # most shingles that the list holds: 32 MB
HOT = 10  # power of 2 of the times from which a shingle's rows are spread
HELD = 4 << 20  # shingles that a task holds before it hands their counts on
MINI = 8  # long numbers of the parity sketch that members carry
MARKS = 1 << 25  # bits of the map of texts to compare: 4 MB, with its keys 8
_MINI = [f"m{i}" for i in range(MINI)]
_PLACES = "key long, cell long, sid binary, n int, rest int, core boolean, known boolean"
_SHARED = "cell long, sid binary, n int, rest int, core boolean, other binary"


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of each text, in order of row and hash.

    A text of 1 to k-1 words has its whole sequence of words as its only shingle.
    """
    words = words_of(texts, True, NOT_SPACE)
    word = words.hashes()
    starts = words.whole(k)
    rows, hashes = [words.row[starts]], [windows(word, starts, k)]
    for short in range(1, k):
        few = words.at[:-1][words.counts == short]
        rows.append(words.row[few])
        hashes.append(mix(windows(word, few, short) ^ U(short)))
    row, value = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def set_ids(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, pa.Array]:
    """Size and a 128-bit name of each row's set; null for an empty set."""
    sizes = np.bincount(row, minlength=rows)
    full = np.flatnonzero(sizes)
    names = np.zeros((rows, 2), dtype=">u8")
    if len(full):
        start = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        for i, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            names[full, i] = mix(np.add.reduceat(mix(value ^ U(salt)), start) + sizes[full].astype(U))
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), rows, [None, pa.py_buffer(names.tobytes())])
    return sizes, pc.if_else(pa.array(sizes > 0), fixed.cast(pa.binary()), pa.scalar(None, pa.binary()))


def _slice_bits(docs: DataFrame) -> int:
    """Bits of a hash that name its slice: sixteen slices for each shuffle partition."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min((16 * partitions - 1).bit_length(), 24)


def _first_of_each(sizes: np.ndarray, sid: pa.Array) -> np.ndarray:
    """Rows that are the first with their set in the chunk; empty sets are left out."""
    first = {}
    for i, name in enumerate(sid.to_pylist()):
        if name is not None:
            first.setdefault(name, i)
    return np.fromiter(first.values(), np.int64, len(first))


def sketches(row: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """How many shingles of each set are in each class of their hash, up to 255.

    There are ``CORNERS`` classes, doubled until a class has ``FILL`` shingles at most on average, so that
    unrelated sets of any size look different.
    """
    classes = CORNERS << np.ceil(np.log2(np.maximum(sizes / (CORNERS * FILL), 1))).astype(np.int64)
    out = [b""] * len(sizes)
    for n in np.unique(classes):
        rows = np.flatnonzero(classes == n)
        place = np.full(len(sizes), -1)
        place[rows] = np.arange(len(rows))
        own = place[row] >= 0
        counts = np.bincount(place[row[own]] * n + (value[own] % U(n)).astype(np.int64), minlength=len(rows) * n)
        for i, line in zip(rows, np.minimum(counts, 255).astype(np.uint8).reshape(len(rows), n), strict=True):
            out[i] = line.tobytes()
    return out


def parities(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """For each set a line of bits: whether an odd number of its shingles is in each class of their hash."""
    out = np.zeros(rows * MINI, dtype=U)
    bit = mix(value ^ U(0x452821E638D01377)) >> U(64 - (64 * MINI - 1).bit_length())
    np.bitwise_xor.at(out, row * MINI + (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63)))
    return out.reshape(rows, MINI).view(np.int64)


def _odd(one: str, two: str):
    """In how many bits the parity sketches in columns with these prefixes differ: the sets differ in no fewer shingles."""
    return sum((F.bit_count(F.col(f"{one}{m}").bitwiseXOR(F.col(f"{two}{m}"))) for m in _MINI[1:]), F.bit_count(F.col(f"{one}m0").bitwiseXOR(F.col(f"{two}m0"))))


def least_difference(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """By how many shingles two sets differ at least, from their sketches; 0 where a count was cut off."""
    out = np.zeros(len(one), dtype=np.int64)
    kinds = np.array([(len(a), len(b)) for a, b in zip(one, two, strict=True)]).reshape(-1, 2)
    for la, lb in np.unique(kinds, axis=0):
        at = np.flatnonzero((kinds == (la, lb)).all(axis=1))
        n = min(la, lb)
        a, b = (np.frombuffer(b"".join(x[i] for i in at), np.uint8).reshape(len(at), -1) for x in (one, two))
        whole = (a.max(axis=1) < 255) & (b.max(axis=1) < 255)
        a, b = (x.reshape(len(at), -1, n).sum(axis=1, dtype=np.int32) for x in (a, b))
        out[at] = np.where(whole, np.abs(a - b).sum(axis=1), 0)
    return out


def sets(docs: DataFrame, bits: int, k: int = SHINGLE) -> DataFrame:
    """doc_id, body, n, sid, sketch and parity sketch for each row; and rows of slice, codes, times: how often shingles were seen.

    A slice is named by the first ``bits`` of a hash, a code is the 32 bits after them. Equal sets of a
    chunk are counted once, and a task adds up what it holds before it hands it on, so a shingle of all documents has few entries.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "body", "n", "sid", "sketch", *_MINI, "slice", "codes", "times"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids = [], None

        def counted() -> pa.RecordBatch:
            code, times = np.unique(np.concatenate(held) >> U(32 - bits), return_counts=True)
            slices, first = np.unique((code >> U(32)).astype(np.int32), return_index=True)
            ends = [*first[1:], len(code)]
            low, times, m = code.astype(np.uint32), times.astype(np.uint32), len(slices)
            packed = [pa.array([x[i:j].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary()) for x in (low, times)]
            empty = [pa.nulls(m, t) for t in (ids, pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * MINI)]
            return pa.RecordBatch.from_arrays([*empty, pa.array(slices), *packed], names=names)

        for batch in chunks(batches, "text"):
            ids, m = batch.column("doc_id").type, batch.num_rows
            row, value = shingle_sets(batch.column("text"), k)
            sizes, sid = set_ids(row, value, m)
            chosen = np.zeros(m, dtype=bool)
            chosen[_first_of_each(sizes, sid)] = True
            sketch = pa.array(sketches(row, value, sizes), pa.binary())
            mini = [pa.array(np.ascontiguousarray(column)) for column in parities(row, value, m).T]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("body"), pa.array(sizes), sid, sketch, *mini, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], names=names
            )
            held.append(value[chosen[row]])
            if sum(map(len, held)) >= HELD:
                yield counted()
                held = []
        if any(map(len, held)):
            yield counted()

    narrow = docs.select("doc_id", F.xxhash64("text").alias("body"), "text")
    minis = ", ".join(f"{m} long" for m in _MINI)
    return narrow.mapInArrow(scan, f"doc_id {kind}, body long, n long, sid binary, sketch binary, {minis}, slice int, codes binary, times binary")


def frequent_shingles(counts: DataFrame) -> DataFrame:
    """code (bits of the slice and the 32 after them) and level (power of 2 of the times seen) of shingles seen ``FREQUENT`` times or more."""

    def total(group: pa.Table) -> pa.Table:
        code, times = (np.frombuffer(b"".join(group.column(c).to_pylist()), np.uint32) for c in ("codes", "times"))
        order = np.argsort(code, kind="stable")
        code, times = code[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        seen = np.add.reduceat(times, first, dtype=np.int64)
        many = seen >= FREQUENT
        whole = (group.column("slice")[0].as_py() << 32) + code[first][many].astype(np.int64)
        return pa.table({"code": pa.array(whole), "level": pa.array(np.floor(np.log2(seen[many])).astype(np.int32))})

    return counts.select("slice", "codes", "times").groupBy("slice").applyInArrow(total, "code long, level int")


def frequency_list(frequent: DataFrame) -> np.ndarray:
    """The frequent shingles in order of code, each as 64 * code + level.

    Of more than ``LISTED`` the levels that fit are listed, from the highest; the others go by their hash
    like rare ones. Any order of shingles gives exact results; rare ones first keeps cells small.
    """
    least, room = 64, LISTED
    for level, count in sorted(((r["level"], r["count"]) for r in frequent.groupBy("level").count().collect()), reverse=True):
        if count > room:
            break
        least, room = level, room - count
    rows = frequent.filter(F.col("level") >= least).select((F.col("code") * 64 + F.col("level")).alias("entry")).toPandas()
    return np.sort(rows["entry"].to_numpy(dtype=np.int64)).view(U)


def _levels(value: np.ndarray, listed: np.ndarray, codes: np.ndarray, bits: int) -> np.ndarray:
    """The level of each shingle in the list, 0 for others. ``codes``: those of the list."""
    if not len(codes):
        return np.zeros(len(value), dtype=np.uint8)
    code = value >> U(32 - bits)
    at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    return np.where(codes[at] == code, listed[at] & U(63), U(0)).astype(np.uint8)


def postings(docs: DataFrame, listed: np.ndarray, bits: int, k: int = SHINGLE) -> DataFrame:
    """Places of each set in its cells: cell (a shingle), sid, n, rest (shingles from this one on), core.

    A set of n shingles, rarest first, is in the cells of so many of its first that any linked set shares
    one of them. ``core`` marks those that a set at least as large must share. ``key`` is the cell, which is
    null then, but for frequent shingles (``known``), whose cells certainly have several members, it spreads the rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(listed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = shared.value
        codes = listed >> U(6)
        for batch in chunks(batches, "text"):
            row, value = shingle_sets(batch.column("text"), k)
            sizes, sid = set_ids(row, value, batch.num_rows)
            chosen = np.zeros(batch.num_rows, dtype=bool)
            chosen[_first_of_each(sizes, sid)] = True
            row, value = row[chosen[row]], value[chosen[row]]
            level = _levels(value, listed, codes, bits)
            order = np.lexsort((value, level, row))
            row, value, level = row[order], value[order], level[order]
            n = sizes[row]
            first = np.searchsorted(row, row)
            pos = np.arange(len(row)) - first
            inside = pos <= n - -(-n * NEAR // OF)
            row, value, level, n, pos = row[inside], value[inside], level[inside], n[inside], pos[inside]
            known = level >= HOT
            spread = mix(value + mix(np.arange(len(value), dtype=U)))
            core = pos <= n - -(-n * 2 * NEAR // (NEAR + OF))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.where(known, spread, value).view(np.int64)),
                    pa.array(value.view(np.int64), mask=~known),
                    sid.take(pa.array(row)),
                    pa.array(n.astype(np.int32)),
                    pa.array((n - pos).astype(np.int32)),
                    pa.array(core),
                    pa.array(known),
                ],
                names=["key", "cell", "sid", "n", "rest", "core", "known"],
            )

    return docs.select("text").mapInArrow(scan, _PLACES)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal keys."""
    first = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), dtype=bool), key[1:] != key[:-1]]))
    return first, np.diff(np.append(first, len(key)))


def _once(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Of rows in order of key and sid those that differ from the one before."""
    if rows.num_rows < 2:
        return rows
    key, sid = rows.column("key").to_numpy(), rows.column("sid").dictionary_encode().indices.to_numpy()
    return rows.filter(pa.array(np.concatenate([[True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])])))


def _members_of(rows: pa.RecordBatch) -> pa.RecordBatch:
    cell = pc.coalesce(rows.column("cell"), rows.column("key"))
    rest = [rows.column(c) for c in ("sid", "n", "rest", "core")]
    return pa.RecordBatch.from_arrays([cell, *rest, pa.nulls(rows.num_rows, pa.binary())], names=["cell", "sid", "n", "rest", "core", "other"])


def _cell_pairs(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The pairs in cells of at most ``LEAF`` members that may link; see ``_leaf_pairs``."""
    key, n, rest = (rows.column(c).to_numpy() for c in ("key", "n", "rest"))
    core = rows.column("core").to_numpy(zero_copy_only=False)
    one, two = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for step in range(1, min(LEAF, len(key))):
        enough = (NEAR + OF) * np.minimum(rest[:-step], rest[step:]) >= NEAR * (n[:-step] + n[step:])
        at = np.flatnonzero((key[:-step] == key[step:]) & enough & (core[:-step] | core[step:]))
        one.append(at)
        two.append(at + step)
    i, j = np.concatenate(one), np.concatenate(two)
    empty = [pa.nulls(len(i), t) for t in (pa.int64(), pa.int32(), pa.bool_())]
    both, sid = pa.array((n[i] + n[j]).astype(np.int32)), rows.column("sid")
    return pa.RecordBatch.from_arrays([empty[0], sid.take(pa.array(i)), both, empty[1], empty[2], sid.take(pa.array(j))], names=["cell", "sid", "n", "rest", "core", "other"])


def shared_cells(places: DataFrame) -> DataFrame:
    """What cells with several members yield: cell, sid, n, rest, core of each member, or the pairs of a small cell.

    A cell of at most ``LEAF`` members is compared at once: sid and other are two sets that may link, n the sum of their
    sizes, the rest null. Members of larger cells have no other. Streams rows sorted by key and set.
    """

    def cells(rows: pa.RecordBatch, large: int | None) -> Iterator[pa.RecordBatch]:
        """Of whole cells, but that the first may go on the one of key ``large``."""
        key = rows.column("key").to_numpy()
        first, times = _runs(key)
        rows = _once(rows.filter(pa.array(np.repeat((times > 1) | (key[first] == large), times))))
        key = rows.column("key").to_numpy()
        first, times = _runs(key)
        many = np.repeat((times > LEAF) | (key[first] == large), times)
        yield _members_of(rows.filter(pa.array(many)))
        yield _cell_pairs(rows.filter(pa.array(~many)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None  # members of the last cell while they are few, the key of the last cell that has many
        for batch in batches:
            yield _members_of(batch.filter(batch.column("known")))
            rows = batch.filter(pc.invert(batch.column("known")))
            if held is not None and held.num_rows:
                rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
            if not rows.num_rows:
                continue
            key = rows.column("key").to_numpy()
            tail = int(_runs(key)[0][-1])
            yield from cells(rows.slice(0, tail), large)
            held = _once(rows.slice(tail))
            if held.num_rows > LEAF or key[-1] == large:
                yield _members_of(held)
                held, large = None, key[-1]
        if held is not None:
            yield from cells(held, large)

    ordered = places.repartition("key").sortWithinPartitions("key", "sid")
    return ordered.mapInArrow(scan, _SHARED)


def overlaps(pairs: DataFrame, texts: DataFrame, k: int = SHINGLE) -> DataFrame:
    """a, b, common, na, nb of pairs of sets, counted on their whole texts. ``texts``: sid, text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in chunks(batches, "ta") for part in chunks(iter([whole]), "tb")):
            texts = pa.chunked_array([batch.column("ta"), batch.column("tb")]).combine_chunks().dictionary_encode()
            row, value = shingle_sets(texts.dictionary, k)
            at = np.searchsorted(row, np.arange(len(texts.dictionary) + 1))
            code, m = texts.indices.to_numpy(), batch.num_rows
            common = [len(np.intersect1d(value[at[i] : at[i + 1]], value[at[j] : at[j + 1]], assume_unique=True)) for i, j in zip(code[:m], code[m:], strict=True)]
            size = np.diff(at)
            columns = [pa.array(x, pa.int64()) for x in (common, size[code[:m]], size[code[m:]])]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *columns], names=["a", "b", "common", "na", "nb"])

    one = texts.select(F.col("sid").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("sid").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(scan, "a binary, b binary, common long, na long, nb long")


def _linked():
    return F.col("common") * OF >= (F.col("na") + F.col("nb") - F.col("common")) * NEAR


def classes_of(links: DataFrame, stages: Stages, name: str) -> DataFrame:
    """sid and label (the smallest sid of its class) of all sets in ``links`` (a, b).

    Labels take the smallest label next to them, then the label of their label, until nothing changes.
    Minima combine map-side, so a set with a third of all links is no hot spot.
    """
    both = stages.write(f"{name}-links", links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stages.write(f"{name}-labels", both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "sid"))
    step = 0
    while True:
        step += 1
        near = both.join(labels.withColumnRenamed("sid", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "sid"), "sid").select("sid", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        lower = stages.write(f"{name}-lower-{step}", lower)
        jump = lower.select(F.col("sid").alias("label"), F.col("label").alias("next"))
        after = stages.write(f"{name}-labels-{step}", lower.join(jump, "label").select("sid", "was", F.least("label", "next").alias("label")))
        if after.filter("label <> was").isEmpty():
            break
        stages.drop(f"{name}-lower-{step - 1}", f"{name}-labels-{step - 1}")
        labels = after.select("sid", "label")
    stages.drop(f"{name}-links")
    return after.select("sid", "label")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))


def size_bands(cells: DataFrame) -> DataFrame:
    """Members in regions of a cell and a band of sizes, with the next band as a window.

    Linked sets differ in size by no more than 4/3, the width of a band: the ring of a set around the
    empty set, so to speak. ``away`` has a bit for each step in which a member is in its region as a copy
    only: 1 here, others in ``rings``. Two members that are away in one step meet elsewhere, others must meet here.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(OF / NEAR)) + 1e-9).cast("int")
    at = F.explode(F.array(F.struct(band.alias("band"), F.lit(0).alias("away")), F.struct((band - 1).alias("band"), F.lit(1).alias("away"))))
    placed = cells.select("cell", "sid", "n", "rest", "core", at.alias("at"))
    return placed.select(F.xxhash64("cell", "at.band").alias("region"), "sid", "n", "rest", "core", "at.away")


def _unfinished(members: DataFrame) -> DataFrame:
    """Regions in which several classes meet, with a core member, and not all of them away in one step; see ``size_bands``.

    ``least`` and ``most`` bound the sizes and the rests of the members. Labels are told
    apart by a 64-bit hash, which Spark aggregates without sorting.
    """
    label = F.xxhash64("label")
    regions = members.groupBy("region").agg(
        (F.min(label) != F.max(label)).alias("mixed"),
        F.bool_or("core").alias("cored"),
        (F.bit_and("away") == 0).alias("homely"),
        F.min("n").alias("least"),
        F.max("rest").alias("most"),
        F.count(F.lit(1)).alias("members"),
    )
    return regions.filter("mixed AND cored AND homely").select("region", "least", "most", "members")


def _open_members(members: DataFrame, regions: DataFrame) -> DataFrame:
    """Members of the regions that can have a link there.

    A link needs 3/7 of both sizes in common, counted from the shared shingle on, and the other set has at
    least 3/4 of the size and no less than the smallest here. Who falls short with any partner is left out.
    """
    near = members.join(regions.drop("members"), "region")
    partner = F.greatest("least", F.ceil(F.col("n") * NEAR / OF).cast("int"))
    enough = (NEAR + OF) * F.least("rest", "most") >= NEAR * (F.col("n") + partner)
    return near.filter(enough).drop("least", "most")


def _leaf_pairs(members: DataFrame) -> DataFrame:
    """a, b of members of one region that may link: in different classes, with a core one, not away in the same step, and enough to share.

    Linked sets differ in a seventh of the sum of their sizes at most, which parity sketches contradict for most others.
    """
    two = members.select("region", *[F.col(c).alias(f"_{c}") for c in ("sid", "n", "rest", "core", "away", "label", *_MINI)])
    enough = (NEAR + OF) * F.least("rest", "_rest") >= NEAR * (F.col("n") + F.col("_n"))
    able = enough & (F.col("core") | F.col("_core")) & (F.col("away").bitwiseAND(F.col("_away")) == 0) & (F.col("label") != F.col("_label"))
    like = _odd("", "_") * (NEAR + OF) <= (F.col("n") + F.col("_n")) * (OF - NEAR)
    pairs = members.join(two, (members["region"] == two["region"]) & (F.col("sid") < F.col("_sid")) & able & like)
    return pairs.select(F.col("sid").alias("a"), F.col("_sid").alias("b")).distinct()


def _alike(pairs: DataFrame, minis: DataFrame) -> DataFrame:
    """a, b of the pairs of small cells that parity sketches do not contradict; see ``_leaf_pairs``."""
    one = minis.withColumnRenamed("sid", "a")
    two = minis.select(F.col("sid").alias("b"), *[F.col(m).alias(f"_{m}") for m in _MINI])
    like = _odd("", "_") * (NEAR + OF) <= F.col("n") * (OF - NEAR)
    return pairs.select(F.col("sid").alias("a"), F.col("other").alias("b"), "n").join(one, "a").join(two, "b").filter(like).select("a", "b")


def rings(members: DataFrame, bounds: DataFrame, linked: DataFrame, step: int) -> DataFrame:
    """Members in the regions around their pivots: those near it, and the others.

    A link to a near member (at EPS or less) reaches no farther than twice EPS from the pivot. So others
    that may be within that window are copied to the near region, to meet its near members; as copies they
    are away in this ``step`` (from 1), besides the steps in which they were before. The pivot has met everyone and is left out. ``bounds``: a (member), b (pivot), low (no more than their distance), where the members' own ``least_low`` is not enough; ``linked``: a, b.
    """
    met = members.filter("sid <> pivot").join(
        bounds.select(F.col("a").alias("sid"), F.col("b").alias("pivot"), "low"), ["sid", "pivot"], "left"
    )
    met = met.withColumn("low", F.coalesce("low", "least_low"))
    met = met.join(linked.select(F.col("a").alias("sid"), F.col("b").alias("pivot"), F.lit(True).alias("near")), ["sid", "pivot"], "left")
    near = F.coalesce("near", F.lit(False))
    inner = F.struct(F.lit(0).alias("ring"), F.when(near, F.col("away")).otherwise(F.col("away").bitwiseOR(F.lit(1 << step))).alias("away"))
    outer = F.struct(F.lit(1).alias("ring"), F.col("away").alias("away"))
    at = F.when(near, F.array(inner)).when(F.col("low") <= 2 * EPS + 1e-9, F.array(inner, outer)).otherwise(F.array(outer))
    placed = met.select("region", "sid", "n", "rest", "core", F.explode(at).alias("at"))
    return placed.select(F.xxhash64("region", "at.ring").alias("region"), "sid", "n", "rest", "core", "at.away")


def _perhaps(rows: DataFrame, key: str, chosen: DataFrame, other: str) -> DataFrame:
    """The rows whose ``key`` may be among the chosen ones' ``other``, by a map of ``MARKS`` bits, so that few of them move to a join.

    Both are 64-bit hashes. With many more chosen ones than bits more rows pass; none that is chosen is ever left out.
    """

    def word(of: str):
        return F.expr(f"shiftright({of} & {MARKS - 1}L, 6)")

    def bit(of: str) -> str:
        return f"shiftleft(1L, cast({of} & 63 as int))"

    words = chosen.groupBy(word(other).alias("_word")).agg(F.expr(f"bit_or({bit(other)})").alias("_bits"))
    marked = rows.withColumn("_word", word(key)).join(F.broadcast(words), "_word")
    return marked.filter(f"(_bits & {bit(key)}) <> 0").drop("_word", "_bits")


def _one_of_each(known: DataFrame) -> DataFrame:
    """sid, n, sketches, doc_id and body of each set, from the row of smallest id that has the set."""
    rest = [c for c in known.columns if c not in ("sid", "doc_id", "body")]
    one = known.filter("sid IS NOT NULL").groupBy("sid").agg(F.min(F.struct("doc_id", "body", *rest)).alias("row"))
    return one.select("sid", "row.*")


def _bounds(pairs: DataFrame, one_of_each: DataFrame) -> DataFrame:
    """The pairs (a, b) with low, a bound below their distance from the sketches alone.

    Counts by class differ by no more than the sets do, and sets that differ in s shingles are
    2s / (sum of sizes + s) apart.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid"))
    sketches = _perhaps(one_of_each.select("sid", "n", "sketch"), "xxhash64(sid)", wanted, "xxhash64(sid)")
    one = sketches.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = sketches.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            apart = least_difference(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            low = 2.0 * apart / np.maximum(total + apart, 1)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(low)], names=["a", "b", "low"])

    return pairs.join(one, "a").join(two, "b").mapInArrow(scan, "a binary, b binary, low double")


def _texts_of(docs: DataFrame, one_of_each: DataFrame, wanted: DataFrame, stages: Stages) -> DataFrame:
    """sid and text of the wanted sets.

    The rows to read are written first, so that Spark knows whether they are few enough to leave the texts in place.
    """
    chosen = one_of_each.join(wanted, "sid", "left_semi").select("sid", F.col("doc_id").alias("_id"), F.col("body").alias("_body"))
    chosen = stages.write("chosen", chosen)
    named = _perhaps(docs.select("doc_id", F.xxhash64("text").alias("body"), "text"), "body", chosen, "_body")
    same = named["doc_id"].eqNullSafe(chosen["_id"]) & (named["body"] == chosen["_body"])
    return named.join(chosen, same).select("sid", "text").dropDuplicates(["sid"])


def link_classes(docs: DataFrame, k: int = SHINGLE, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the class), size (rows in the class), for each row of ``docs``.

    Words are lower-cased in A-Z only. Texts with fewer than ``k`` words have one shingle; those without
    words, and null texts, have none and are classes of their own. Equal sets are linked and compared as
    one. Rows without id belong to classes, but the smallest id is that of other rows; it is null if there
    is none. Repeated rows are reported each. No documents: no rows. Extra columns are ignored.
    Shingles are compared by 64-bit hashes, sets named by 128 bits.
    """
    stages = Stages(docs.sparkSession)
    bits = _slice_bits(docs)
    scanned = stages.write("sets", sets(docs, bits, k))
    order = frequency_list(stages.write("frequent", frequent_shingles(scanned.filter("slice IS NOT NULL"))))
    known = stages.write("known", scanned.filter("slice IS NULL").drop("slice", "codes", "times"))
    stages.drop("sets", "frequent")
    one = stages.write("one", _one_of_each(known))
    minis = one.select("sid", *_MINI)
    cells = stages.write("cells", shared_cells(postings(docs, order, bits, k)).distinct())

    members = size_bands(cells.filter("other IS NULL")).withColumn("label", F.col("sid"))
    links = labels = None
    for number in range(rounds + 1):
        able = _open_members(members, stages.write(f"open-{number}", _unfinished(members)))
        able = stages.write(f"able-{number}", able.join(minis, "sid"))
        regions = stages.write(f"mixed-{number}", _unfinished(able).select("region", "members"))
        small = F.lit(True) if number == rounds else F.col("members") <= LEAF
        pairs = _leaf_pairs(able.join(regions.filter(small), "region", "left_semi"))
        if number == 0:
            pairs = pairs.unionByName(_alike(cells.filter("other IS NOT NULL"), minis)).distinct()
        first = F.min(F.struct(F.bit_count("away"), "sid", "n", *_MINI)).alias("at")
        pivots = able.groupBy("region").agg(first).select("region", F.col("at.sid").alias("pivot"), *[F.col(f"at.{c}").alias(f"pivot_{c}") for c in ("n", *_MINI)])
        pivots = stages.write(f"pivots-{number}", pivots.join(regions.filter(~small), "region", "left_semi"))
        deeper = not pivots.isEmpty()
        if deeper:
            apart = _odd("", "pivot_")
            low = 2.0 * apart / F.greatest(F.col("n") + F.col("pivot_n") + apart, F.lit(1))
            met = able.join(pivots, "region").withColumn("least_low", low)
            members = stages.write(f"members-{number}", met.select("region", "sid", "n", "rest", "core", "away", "pivot", "least_low"))
            near = members.filter((F.col("sid") != F.col("pivot")) & (F.col("least_low") <= 2 * EPS + 1e-9))
            pairs = pairs.unionByName(near.select(F.col("sid").alias("a"), F.col("pivot").alias("b"))).distinct()
        pairs = stages.write(f"pairs-{number}", pairs)
        bounds = stages.write(f"bounds-{number}", _bounds(pairs, one))
        near = stages.write(f"near-{number}", bounds.filter(F.col("low") <= EPS + 1e-9).select("a", "b"))
        texts = stages.write("texts", _texts_of(docs, one, near.select(F.explode(F.array("a", "b")).alias("sid")), stages))
        counted = stages.write(f"overlaps-{number}", overlaps(near, texts, k))
        found = counted.filter(_linked()).select("a", "b")
        links = stages.write(f"links-{number}", found if links is None else links.unionByName(found))
        labels = classes_of(links, stages, f"classes-{number}")
        if not deeper:
            break
        if number == 0:
            one = stages.write("one", one.join(able.select("sid"), "sid", "left_semi"))  # no others are members later
            minis = one.select("sid", *_MINI)
        placed = stages.write(f"rings-{number}", rings(members, bounds, found, number + 1))
        members = _labelled(placed, labels)
        stages.drop(f"able-{number}", f"open-{number}", f"members-{number}", f"overlaps-{number}", f"pairs-{number}", f"rings-{number - 1}")
    stages.drop("texts", "cells", "one")

    rows = known.select("doc_id", "sid", "n")
    rows = rows.join(labels, "sid", "left")
    rows = stages.write("rows", rows.select("doc_id", "n", F.coalesce("label", "sid").alias("class")))
    least = stages.write("least", rows.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("size")))
    joined = rows.join(least, "class", "left")
    alone = F.col("class").isNull()
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("size")).cast("long").alias("size"),
    )


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    """Class of linked documents of every document."""
    return link_classes(table(spark, sf_dir, "documents")).drop("size")


#: no id here is null or repeated; shingles are words joined by single spaces
OP8_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(words) >= 5 THEN [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle
  FROM worded
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM shingled a JOIN shingled b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * common >= 75 * (a.n + b.n - common)
), reached AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
), lowest AS (
  SELECT x, min(y) AS y FROM reached GROUP BY x
)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(l.y, w.doc_id))::BIGINT AS component_id
FROM worded w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN lowest l ON l.x = w.doc_id
"""

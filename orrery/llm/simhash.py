"""SimHash near-duplicates through pigeonhole blocks.

A fingerprint is cut into six blocks of bits. Two that differ in at most four bits agree in two blocks
at least, so each is listed under its fifteen pairs of blocks. Fingerprints that share such a key meet,
sorted, in one pass that verifies their Hamming distance and links each cluster by a spanning tree: the
rows that come out are as many as fingerprints, not pairs. Keys are counted first. The members of one with
more fingerprints than fit never meet in a task: they are linked through all values within half the
distance instead, since two fingerprints within four bits share a value within two of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import checkpoint, releasing, texts
from orrery.llm.components import components, splittable

BITS, DISTANCE = 64, 4
#: Blocks and how many of them two linked fingerprints must share: BLOCKS - DISTANCE.
BLOCKS = DISTANCE + 2
#: Fingerprints of one key that are compared in memory.
MOST_IN_KEY = 8192
SHINGLE, SEED = 4, 42
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Shingles whose hashes are unpacked to bits at a time.
AT_ONCE = 1 << 15


def digests(words: list[bytes], size: int) -> np.ndarray:
    """Unsigned XXH64 of the runs of ``size`` words, in their order and with repeats; fewer words, but not none, are one run."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """A bit is set where more than half the hashes have it."""
    n = len(hashes)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, AT_ONCE):
        counts += np.unpackbits(hashes[at : at + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text: a bit is set where more than half the shingles' XXH64 have it."""
    return majority(digests(text.translate(LOWER).split(), size))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint as a signed 64-bit integer) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_buffer().to_pybytes(), size) for x in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    narrow = texts(docs, doc_id, text=text).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return narrow.mapInArrow(releasing(run), "doc_id bigint, text_hash bigint, fp bigint")


def spanning(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For unsigned fingerprints (numpy counts the bits of signed ones without their sign): edges that connect exactly what the graph of pairs within DISTANCE connects."""
    left, right, rest = [], [], fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= DISTANCE
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), x))
                right.append(found)
                queue += list(found)
                rest = rest[~near]
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(left + none), np.concatenate(right + none)


def link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, fp), of keys whose members fit, to edges (a, b)."""
    held_key: int | None = None
    held: list[np.ndarray] = []

    def out(a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

    def settle() -> Iterator[pa.RecordBatch]:
        if sum(map(len, held)) > 1:
            a, b = spanning(np.concatenate(held))
            if len(a):
                yield out(a, b)

    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(keys):
            continue
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = np.concatenate([[0], cuts, [len(keys)]])
        lengths, last = np.diff(edges), len(edges) - 2
        # Runs inside the batch: those of two at once, longer ones one by one.
        inner = np.arange(1, last)
        two = edges[:-1][inner[lengths[inner] == 2]]
        near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= DISTANCE
        if near.any():
            yield out(fps[two][near], fps[two + 1][near])
        more = [0, *inner[lengths[inner] > 2].tolist(), *([last] if last else [])]
        for r in more:
            a, b = int(edges[r]), int(edges[r + 1])
            key = int(keys[a])
            if key != held_key:
                yield from settle()
                held_key, held = key, []
            held.append(fps[a:b])
            if r not in (0, last):
                yield from settle()
                held_key, held = None, []
    yield from settle()


def block_keys(fp: str):
    """An array column of the keys of a fingerprint, one for each pair of blocks."""
    edges = [round(k * BITS / BLOCKS) for k in range(BLOCKS + 1)]
    block = lambda k: F.shiftrightunsigned(F.col(fp), edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1).cast("bigint"))
    return F.array(*(
        F.shiftleft(F.shiftleft(F.lit(n).cast("bigint"), 12).bitwiseOR(block(i)), 12).bitwiseOR(block(j))
        for n, (i, j) in enumerate(combinations(range(BLOCKS), BLOCKS - DISTANCE))
    ))


def links(fps: DataFrame, most_in_key: int = MOST_IN_KEY) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all that lie within DISTANCE of each other."""
    listed = fps.select(F.explode(block_keys("fp")).alias("key"), "fp")
    hot = checkpoint(listed.groupBy("key").count().where(F.col("count") > most_in_key).select("key"))
    crowded = not hot.isEmpty()
    rest = listed.join(hot, "key", "left_anti") if crowded else listed
    dealt = rest.repartition("key").sortWithinPartitions("key", "fp")
    edges = checkpoint(dealt.mapInArrow(releasing(link_runs), "a bigint, b bigint"))
    if not crowded:
        return edges
    masks = [0, *(1 << i for i in range(BITS)), *(1 << i | 1 << j for i, j in combinations(range(BITS), 2))]
    around = F.array(*(F.lit(m - (1 << BITS) if m >> (BITS - 1) else m).cast("bigint") for m in masks))
    members = checkpoint(listed.join(hot, "key", "left_semi").select(F.col("fp").alias("a")).distinct())
    near = members.select("a", F.explode(F.transform(around, lambda m: m.bitwiseXOR(F.col("a")))).alias("g"))
    # A value is within two bits of 2,081 others at most, so its group is small whatever the data.
    stars = near.select("a", F.min("a").over(Window.partitionBy("g")).alias("b")).where("a <> b").distinct()
    return edges.unionByName(stars)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, most_in_key: int = MOST_IN_KEY) -> DataFrame:
    """Fingerprint and component of every row: doc_id, text_hash, fingerprint, component_id.

    Words are runs of non-space characters with A-Z lower-cased, shingles ``size`` words with repeats
    (a shorter text is one shingle; a null, empty or blank one has fingerprint zero and is linked like any
    other). component_id is the least doc_id that links reach; null where all those ids are null.
    Equal rows come out each; other columns, whatever their names, play no part; an empty table gives no
    rows. Equal texts meet as one fingerprint before anything is compared.
    """
    rows = checkpoint(fingerprints(docs, doc_id, text, size))
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(fps.select("fp"), most_in_key))
    placed = fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = splittable(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    of_fp = placed.join(named, "root").select("fp", "component_id")
    joined = rows.join(of_fp, "fp")
    return joined.select("doc_id", "text_hash", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each component, with all their columns, whatever their names.

    It is the row of least doc_id (null last), then of the least hash of the text, then of the least hash of all
    columns (maps aside); of rows equal in all that, any one. Null and empty texts are alike; a component
    without any id keeps one row too; an empty table gives no rows. The text goes through one shuffle, copies
    of a row folded before it.
    """
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")
    # A group without any id has no component_id; its fingerprint stands for it.
    group = F.coalesce(F.col("component_id").cast("string"), F.col("fingerprint"))
    kept = found.groupBy(group.alias("g")).agg(F.min(order).alias("k")).select("k.z", F.coalesce("k.doc_id", F.lit(0)).alias("i"), F.col("k.text_hash").alias("h")).distinct()
    column = lambda c: F.col(f"`{c}`")
    whole = [column(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    number = column(doc_id).cast("bigint")
    keyed = docs.select(
        number.isNull().alias("z"), F.coalesce(number, F.lit(0)).alias("i"), F.xxhash64(F.coalesce(column(text).cast("string"), F.lit(""))).alias("h"),
        F.xxhash64(*whole).alias("least"), F.struct(*(column(c) for c in docs.columns)).alias("row"),
    )
    one = keyed.groupBy("z", "i", "h").agg(F.min_by("row", "least").alias("row"))
    return one.join(kept, ["z", "i", "h"], "left_semi").select(*(F.col("row")[c].alias(c) for c in docs.columns))

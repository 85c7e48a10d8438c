"""Near-duplicates by SimHash and exact Jaccard similarity of word shingles.

SimHash fingerprints of the shingles meet through pigeonhole blocks and are linked within four bits, as in
``simhash``. Texts that this links are candidates. Pairs of the similarity asked for may differ in more bits than
blocks can find (5 to 13 are common at 0.8), so the pigeonhole principle is applied to the sets too:

Two sets of at least similarity t share one of the first n - ceil(t n) + 1 shingles of each, in any order
that all sets keep. Each text is listed under these; the order puts shingles that a sample shows to be
frequent last, and before them those of words that it shows to be frequent, which bears on the work alone:
else unlike texts meet by chance, the more of them the more texts there are. Prefixes longer by k - 1 share k
shingles (EXTRA): a text that has fewer in common with all others together is like none of them, which leaves
out those that only share a passage. Keys whose texts another key has too count once. The texts of a key
are compared in memory by the Hamming distance of their parity fingerprints, which rules out what can't be
alike; those of a common key are all taken for candidates. Candidates make groups. A group is compared in
memory, exactly, and linked by a spanning tree. One that doesn't fit is cut into parts: each is compared in
itself and with some pivots of the group, and only texts that this doesn't connect to the group's largest
component are compared with all parts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import simhash
from orrery.llm.common import checkpoint, distinct, list_parts, ragged_gather, releasing, runs, texts
from orrery.llm.components import components, splittable
from orrery.llm.simhash import LOWER, SEED, digests, majority
from orrery.session import discard, scratch, tidy

#: Texts under one key that are compared in memory, and shingles of a part of a group.
MOST_IN_KEY, MOST_IN_PART = 2048, 2 << 20
#: Of about so many texts, shingles that so many hold are put last; of these, the most frequent at most.
SAMPLE, FREQUENT, MOST_FREQUENT = 5_000, 3, 1 << 19
#: Of their words, those that occur so often count as frequent; of these, the most frequent at most, if no longer than so many bytes.
FREQUENT_WORD, MOST_WORDS, LONGEST_WORD = 8, 1 << 14, 64
#: Bits of the filter of texts whose sets are needed, of one of the bitmaps that make it, and a set's parities for each of its shingles, at least.
FILTER_BITS, BITMAP_BITS, PARITIES = 1 << 26, 1 << 15, 4
#: Further shingles of a prefix, as a share of the set: so many must be shared too.
EXTRA = 0.05
#: Texts of a large group with which each of its parts is compared, about.
PIVOTS = 8


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct XXH64 of the runs of ``size`` words; a shorter text is one run."""
    return weighed(text, size, {})[0]


def weighed(text: bytes, size: int, words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``shingles``, the weight of each (the sum of its words'), and the hashes that make the SimHash: unsigned, with repeats."""
    import xxhash

    found = text.translate(LOWER).split()
    if not found:
        return np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64).view(np.int64), np.zeros(1, np.int64), digests(found, size)
    hashes = digests(found, size)
    keys = hashes.view(np.int64)
    if not words:
        keys = distinct(keys)
        return keys, np.zeros(len(keys), np.int64), hashes
    total = np.zeros(len(found) + 1, np.int64)
    np.cumsum(np.fromiter((words.get(w, 0) for w in found), np.int64, len(found)), out=total[1:])
    keys, first = np.unique(keys, return_index=True)
    # The weight depends on the shingle alone, so all sets keep the same order.
    return keys, (total[size:] - total[:-size] if len(found) >= size else total[-1:])[first], hashes


def prefix(keys: np.ndarray, weights: np.ndarray, frequent: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of which a set as similar holds ``least_shared`` among its own: those that aren't frequent, and those that are."""
    n = len(keys)
    # A bit below the product, so that rounding never shortens the prefix.
    take = min(n, n - math.ceil(similarity * n - 1e-6) + 1 + math.floor(_extra(similarity) * n))
    often = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
        often = np.where(frequent[at] == keys, counts[at], 0)
    order = np.lexsort((keys, weights, often))[:take]
    rare = int((often[order] == 0).sum())
    return keys[order[:rare]], keys[order[rare:]]


def _extra(similarity: float) -> float:
    return min(EXTRA, similarity / 2)


def least_shared(n, similarity: float):
    """A column: how many shingles of its prefix a set of ``n`` shares with one as similar, whose size is at least that share of its own."""
    return 1 + F.floor(F.lit(_extra(similarity) * similarity) * n - F.lit(1e-6)) if similarity > 0 else F.lit(0)


def parities(keys: np.ndarray) -> bytes:
    """One bit for each remainder: whether an odd number of shingles has it. Two sets differ in at least as many shingles as bits.

    There are as many remainders as the power of two from PARITIES for each shingle on.
    """
    n = 1 << max(8, (PARITIES * len(keys) - 1).bit_length())
    return np.packbits(np.bincount((keys & (n - 1)), minlength=n).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(bits: np.ndarray) -> np.ndarray:
    """Parities of half as many remainders."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def mixed(h: np.ndarray) -> np.ndarray:
    """Well-spread unsigned numbers, whose sum stands for a set."""
    x = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def memberships(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, h), sorted, to (who, h, null) for each key of two texts or more, where who stands for all its texts;
    to (null, h, least) for keys of more than ``most``. Keys of one text give nothing."""
    held: list[np.ndarray] = []
    held_key, n_held, least = None, 0, None

    def out(who, h, least) -> pa.RecordBatch:
        absent = pa.nulls(len(h), pa.int64())
        first = absent if who is None else pa.array(who.view(np.int64))
        last = absent if least is None else pa.array(np.full(len(h), least))
        return pa.RecordBatch.from_arrays([first, pa.array(h), last], names=["who", "h", "least"])

    def settle() -> Iterator[pa.RecordBatch]:
        if n_held > 1 and held:
            h = np.concatenate(held)
            yield out(None, h, least) if n_held > most else out(np.full(len(h), mixed(h).sum(dtype=np.uint64)), h, None)

    with np.errstate(over="ignore"):
        for batch in batches:
            keys, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
            lengths = np.diff(starts, append=len(keys))
            # Runs inside the batch, all at once; the first and the last one may go on in others.
            inner = np.flatnonzero((lengths > 1) & (lengths <= most))
            inner = inner[(inner > 0) & (inner < len(starts) - 1)]
            if len(inner):
                rows = ragged_gather(np.arange(len(keys)), starts[inner], lengths[inner])
                ends = np.cumsum(lengths[inner])
                who = np.add.reduceat(mixed(h[rows]), ends - lengths[inner])
                yield out(np.repeat(who, lengths[inner]), h[rows], None)
            long = np.flatnonzero(lengths > most)
            for r in sorted({0, len(starts) - 1, *long.tolist()}):
                a, n = int(starts[r]), int(lengths[r])
                if keys[a] != held_key:
                    yield from settle()
                    held, held_key, n_held, least = [], keys[a], 0, h[a]
                held.append(h[a : a + n])
                n_held += n
                if n_held > most:  # a common key's texts are passed on as they come
                    yield out(None, np.concatenate(held), least)
                    held = []
        yield from settle()


def may_be_alike(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (who, h, n, bits), sorted by who, to edges (a, b) that connect those pairs which parities don't rule out."""
    for group in runs(batches, 1):
        h, n = group.column(1).to_numpy(), group.column(2).to_numpy().astype(np.int64)
        data = group.column(3).to_pylist()
        # Sets that may be alike have equally many parities, or one twice as many as the other, which is then folded.
        level = np.array([len(x).bit_length() for x in data])
        place, own, less = np.zeros(len(h), np.int64), {}, {}
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            place[at] = np.arange(len(at))
            own[k] = np.frombuffer(b"".join(data[i] for i in at.tolist()), np.uint64).reshape(len(at), -1)
            less[k] = folded(own[k])
        free, left, right = np.arange(len(h)), [], []
        while len(free):
            queue, free = [int(free[0])], free[1:]
            while queue and len(free):
                x = queue.pop()
                k, near = int(level[x]), np.zeros(len(free), bool)
                for step in (-1, 0, 1):
                    at = np.flatnonzero(level[free] == k + step)
                    if not len(at):
                        continue
                    others = free[at]
                    mine = less[k][place[x]] if step < 0 else own[k][place[x]]
                    theirs = less[k + 1] if step > 0 else own[k + step]
                    least = np.bitwise_count(theirs[place[others]] ^ mine).sum(1, dtype=np.int64)
                    both = n[others] + n[x]
                    near[at] = (both - least) >= similarity * (both + least) - 1e-6
                found = free[near]
                left.append(np.full(len(found), x))
                right.append(found)
                queue += found.tolist()
                free = free[~near]
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(h[a]), pa.array(h[b])], names=["a", "b"])


def by_fingerprint(listed: DataFrame) -> DataFrame:
    """Edges (a, b) that connect just those texts (h, fp) whose fingerprints SimHash connects."""
    fps = checkpoint(listed.groupBy("fp").agg(F.min("h").alias("least"), F.count("*").alias("c")))
    found = simhash.links(fps.select("fp"))
    for end in ("a", "b"):
        found = found.join(fps.select(F.col("fp").alias(end), F.col("least").alias(f"of_{end}")), end)
    same = listed.join(splittable(fps.where("c > 1").select("fp", "least"), "fp"), "fp").where("h <> least")
    return found.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).unionByName(same.select(F.col("h").alias("a"), F.col("least").alias("b")))


def widest(members: DataFrame) -> DataFrame:
    """Members (who, h) of the groups of two or more that aren't part of another: of that one alone which most of a group's members have as their largest."""
    sized = members.groupBy("who").agg(F.count("*").alias("m")).where("m > 1")
    members = checkpoint(members.join(sized, "who"))
    largest = members.groupBy("h").agg(F.max(F.struct("m", "who")).alias("wide"))
    votes = members.select("who", "m", "h").join(largest, "h").groupBy("who", "m", "wide").count()
    chosen = votes.groupBy("who", "m").agg(F.max_by("wide.who", F.struct("count", "wide")).alias("wide")).where("who <> wide")
    both = members.select("who", "h").join(chosen, "who").join(members.select(F.col("who").alias("wide"), "h"), ["wide", "h"])
    # The other is larger, or as large with a greater number: nothing is left out by what it leaves out itself.
    within = both.groupBy("who", "m").count().where("count = m")
    return members.join(within, "who", "left_anti").select("who", "h")


def _hashed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return texts(docs, doc_id, text=text).select(F.xxhash64(text).alias("h"), F.col(text).alias("text"))


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for h, x in zip(batch.column(0).to_numpy().tolist(), batch.column(1), strict=True):
        yield h, shingles(x.as_buffer().to_pybytes(), size)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *rows]), pa.int64()))


def sampled(hashed: DataFrame, size: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, dict[bytes, int]]:
    """Sorted shingles that are frequent in a sample of the texts, how many texts hold each, and the weights of frequent words."""
    share = sample / max(1, hashed.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.concatenate([np.zeros(0, np.int64), *(s for _, s in _sets(batch, size))])
            words = Counter(w for x in batch.column(1) for w in x.as_buffer().to_pybytes().translate(LOWER).split() if len(w) <= LONGEST_WORD)
            columns = [pa.array(keys), pa.nulls(len(keys), pa.binary()), pa.array(np.ones(len(keys), np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "word", "n"])
            columns = [pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "word", "n"])

    some = hashed.where(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1, share)))
    counted = some.mapInArrow(releasing(run), "key bigint, word binary, n bigint").groupBy("key", "word").agg(F.sum("n").alias("n"))
    often = checkpoint(counted.where(F.col("n") >= F.when(F.col("word").isNull(), FREQUENT).otherwise(FREQUENT_WORD)))
    table = often.where("word is null").orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).toArrow().sort_by("key").combine_chunks()
    words = often.where("word is not null").orderBy(F.desc("n"), "word").limit(MOST_WORDS).toArrow()
    weights = np.rint(8 * np.log2(words["n"].to_numpy() / (FREQUENT_WORD / 2))).astype(np.int64).tolist()
    return table["key"].to_numpy(), table["n"].to_numpy(), dict(zip(words["word"].to_pylist(), weights, strict=True))


def picked(hashed: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """(h, s) of the texts whose hashes are needed, and of few others.

    The filter is made of bitmaps that tasks aggregate: what the driver gets and broadcasts is FILTER_BITS at
    most, however many texts are needed; one that is full lets all texts pass.
    """
    place = F.pmod("h", F.lit(FILTER_BITS))
    maps = needed.groupBy(F.floor(place / BITMAP_BITS).cast("int").alias("k")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(BITMAP_BITS))).alias("bits"))
    bits = np.zeros(FILTER_BITS >> 3, np.uint8)
    for row in maps.collect():  # FILTER_BITS in all
        bits[row.k * BITMAP_BITS >> 3 : (row.k + 1) * BITMAP_BITS >> 3] = np.frombuffer(row.bits, np.uint8)
    wanted = hashed.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy() % FILTER_BITS
            part = batch.filter(pa.array((wanted.value[k >> 3] >> (k & 7) & 1).astype(bool)))
            if len(part):
                h, found = zip(*_sets(part, size), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), _lists(list(found))], names=["h", "s"])

    return hashed.mapInArrow(releasing(run), "h bigint, s array<bigint>").groupBy("h").agg(F.first("s").alias("s"))


def spanning(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges of indices that connect exactly what the pairs of at least this similarity connect."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(codes, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(codes))])
    holders, first = owner[order], np.concatenate([[0], np.cumsum(sizes)])
    free, out = np.ones(len(sets), bool), []
    for root in range(len(sets)):
        if not free[root]:
            continue
        free[root], queue = False, [root]
        while queue:
            x = queue.pop()
            mine = codes[first[x] : first[x + 1]]
            met = np.concatenate([holders[starts[c] : starts[c + 1]] for c in mine.tolist()])
            shared = np.bincount(met[free[met]], minlength=len(sets))
            near = np.flatnonzero((shared > 0) & (shared / (sizes + sizes[x] - shared) >= similarity))
            free[near] = False
            out += [(x, k) for k in near.tolist()]
            queue += near.tolist()
    return out


def linked(cells: DataFrame, similarity: float) -> DataFrame:
    """(a, b) from each text to the least of those that similar pairs connect it to, within its cell (root, p, q) of texts (h, s)."""
    key = ["root", "p", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches, 3):
            h = cell.column(3).to_numpy()
            offsets, flat = list_parts(cell.column(4))
            flat, h, first = flat.to_numpy(), *np.unique(h, return_index=True)
            sets = [flat[offsets[k] : offsets[k + 1]] for k in first.tolist()]
            found = np.array(spanning(sets, similarity) if len(sets) > 1 else [], np.int64).reshape(-1, 2)
            if len(found):
                # Trees come one after the other, each from the least text that was free: texts are sorted.
                top = np.arange(len(h))
                for x, k in found.tolist():
                    top[k] = top[x]
                own = np.unique(found[:, 1])
                yield pa.RecordBatch.from_arrays([pa.array(h[own]), pa.array(h[top[own]])], names=["a", "b"])

    dealt = cells.select(*key, "h", "s").repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(releasing(run), "a bigint, b bigint")


def _of_groups(sized: DataFrame, sets: DataFrame, similarity: float, most_in_part: int) -> DataFrame:
    """(h, root) of the texts that similar pairs connect to others within each group (h, root, n), n being a set's size."""
    totals = splittable(sized.groupBy("root").agg(F.count("*").alias("c"), F.ceil(F.sum("n") / most_in_part).cast("int").alias("parts")), "root")
    placed = checkpoint(sized.join(totals, "root").withColumn("p", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int")))
    large = placed.where("parts > 1")
    some_large = not large.isEmpty()
    sets = checkpoint(sets) if some_large else sets
    with_sets = lambda df: df.join(sets, "h")
    none = F.lit(0).alias("q")
    if not some_large:
        stars = checkpoint(linked(with_sets(placed.select("h", "root", "p", none)), similarity)).select(F.col("a").alias("h"), F.col("b").alias("root"))
        return stars.unionByName(stars.select(F.col("root").alias("h"), "root").distinct())
    # Each part with the pivots; which texts those are is a matter of work alone.
    pivots = large.where(F.pmod(F.xxhash64("h", F.lit(5)), F.lit(1 << 20)) < F.lit(PIVOTS << 20) / F.col("c"))
    spread = pivots.select("h", "root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), none)
    edges = checkpoint(linked(with_sets(placed.select("h", "root", "p", none).unionByName(spread)), similarity))
    # Texts outside the largest component of their group meet all parts.
    connected = lambda df: components(df).select(F.col("node").alias("h"), "root")
    parts = checkpoint(connected(edges))
    labelled = large.join(parts.withColumnRenamed("root", "label"), "h", "left").withColumn("label", F.coalesce("label", "h"))
    labelled = checkpoint(labelled)
    largest = splittable(labelled.groupBy("root", "label").count().groupBy("root").agg(F.max_by("label", F.struct("count", "label")).alias("main")), "root")
    rest = checkpoint(labelled.join(largest, "root").where("label <> main").select("h", "root", "n", "parts"))
    if rest.isEmpty():
        return parts
    many = splittable(rest.groupBy("root").agg(F.ceil(F.sum("n") / most_in_part).cast("int").alias("qs")), "root")
    apart = rest.join(many, "root").select("h", "root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), F.pmod(F.xxhash64("h", F.lit(7)), F.col("qs")).cast("int").alias("q"))
    whole = large.join(many, "root").select("h", "root", "p", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"))
    return connected(edges.unionByName(linked(with_sets(apart.unionByName(whole).distinct()), similarity)))


def links(hashed: DataFrame, size: int, similarity: float, most_in_key: int = MOST_IN_KEY, most_in_part: int = MOST_IN_PART, sample: int = SAMPLE) -> DataFrame:
    """(h, root) of the hashes of texts that links of at least the given similarity connect to others."""
    spark = hashed.sparkSession
    shipped = spark.sparkContext.broadcast(sampled(hashed, size, sample))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, counts, words = shipped.value
        for batch in batches:
            found = []
            for h, x in zip(batch.column(0).to_numpy().tolist(), batch.column(1), strict=True):
                s, weights, hashes = weighed(x.as_buffer().to_pybytes(), size, words)
                found.append((h, majority(hashes), len(s), parities(s), *prefix(s, weights, often, counts, similarity)))
            if found:
                h, fps, n, bits, keys, common = zip(*found, strict=True)
                columns = [pa.array(h, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(bits, pa.binary()), _lists(list(keys)), _lists(list(common))]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "fp", "n", "bits", "keys", "common"])

    made = hashed.mapInArrow(releasing(prefixes), "h bigint, fp bigint, n int, bits binary, keys array<bigint>, common array<bigint>")
    path = scratch(spark, "listed")
    made.groupBy("h").agg(*(F.first(c).alias(c) for c in ("fp", "n", "bits", "keys", "common"))).write.parquet(path)
    listed = spark.read.parquet(path)
    near = checkpoint(by_fingerprint(listed.select("h", "fp")))
    dealt = listed.select(F.explode("keys").alias("key"), "h").repartition("key").sortWithinPartitions("key", "h")
    shared = dealt.mapInArrow(releasing(lambda batches: memberships(batches, most_in_key)), "who bigint, h bigint, least bigint")
    members = checkpoint(shared.groupBy("who", "h", "least").agg(F.count("*").alias("c")))
    # Common shingles may all be shared.
    met = listed.select("h", "n", "bits", "common").join(members.groupBy("h").agg(F.sum("c").alias("c")), "h", "left")
    left = checkpoint(met.where(F.coalesce("c", F.lit(0)) + F.size("common") >= least_shared(F.col("n"), similarity)).select("h", "n", "bits", "common"))
    discard(spark, path)
    members = checkpoint(members.join(left.select("h"), "h", "left_semi").select("who", "h", "least"))
    # A key that the sample shows to be common may be held by a large share of all texts: it is counted before its
    # texts meet, so that they can be dealt to many tasks.
    often = left.select("h", F.explode("common").alias("key"))
    least = splittable(often.groupBy("key").agg(F.min("h").alias("least"), F.count("*").alias("c")).where("c > 1"), "key")
    stars = often.join(least, "key").select("h", "least").unionByName(members.where("who is null").select("h", "least"))
    compared = widest(members.where("who is not null").select("who", "h")).join(left.select("h", "n", "bits"), "h").select("who", "h", "n", "bits")
    compared = compared.repartition("who").sortWithinPartitions("who")
    likely = compared.mapInArrow(releasing(lambda batches: may_be_alike(batches, similarity)), "a bigint, b bigint")
    edges = near.unionByName(likely).unionByName(stars.where("h <> least").select(F.col("h").alias("a"), F.col("least").alias("b"))).distinct()
    groups = components(edges).select(F.col("node").alias("h"), "root")
    # Stars start from the least text of a key, and fingerprints link any texts: they may be like no other.
    sized = checkpoint(groups.join(left.select("h", "n"), "h"))
    return _of_groups(sized, picked(hashed, groups.select("h"), size), similarity, most_in_part)


def similar_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """doc_id, text_hash, fingerprint, component_id of every row, for ``keep_one``.

    Texts are linked whose sets of ``size``-word shingles (A-Z lower-cased) have a Jaccard similarity of at
    least ``similarity``; blank and null ones are equal. component_id is the least doc_id that links reach,
    fingerprint names the component where all those ids are null. Equal rows come out each; other columns,
    whatever their names, play no part; an empty table gives no rows.
    """
    hashed = _hashed(docs, doc_id, text)
    with tidy(docs.sparkSession):
        roots = links(hashed, size, similarity, **limits)
    rows = texts(docs, doc_id, text=text).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    least = rows.groupBy("text_hash").agg(F.min("doc_id").alias("least"))
    placed = least.join(roots.select(F.col("h").alias("text_hash"), "root"), "text_hash", "left").select("text_hash", "least", F.coalesce("root", "text_hash").alias("root"))
    named = splittable(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    of_text = splittable(placed.select("text_hash", "root").join(named, "root"), "text_hash")
    joined = rows.join(of_text, "text_hash")
    return joined.select("doc_id", "text_hash", F.lpad(F.lower(F.hex("root")), 16, "0").alias("fingerprint"), "component_id")

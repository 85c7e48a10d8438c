"""Benchmark decontamination by Wu-Manber search over words.

Patterns are windows of ``size`` words of the benchmark items. For each pattern length there is a shift
table over hashed blocks of up to three words: it says how far the search may skip, the least over all blocks
of a slot. A block of shift 0 may end a pattern: then the window's hash leads to the patterns of its bucket,
which are compared with it directly, in the benchmark's own text. The tables are flat arrays, made once on
the driver; their bytes bound how much of a benchmark is searched in one pass.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import releasing, texts

#: A-Z lower-cased, letters, digits and bytes of non-ASCII characters kept, all else a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
BLOCK, SEED = 3, 42
#: Bytes of the tables that are broadcast for one pass, and the most that a byte of benchmark text takes in them: a word
#: and its space are two bytes at least, with 24 of a window's entry (hash, place, length and item) and up to 16 of shifts.
TABLE_BYTES, BYTES_FOR_ONE = 128 << 20, 21
SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


@dataclass
class Matcher:
    """Shift table and buckets of the patterns of one length, over the joined words of all items."""

    length: int
    shift: bytes
    hashes: np.ndarray  # of the patterns, sorted
    begins: np.ndarray  # where each one's words begin in the text, and their bytes
    sizes: np.ndarray
    items: np.ndarray
    text: bytes
    names: list[str]

    @property
    def block(self) -> int:
        return min(BLOCK, self.length)

    @property
    def nbytes(self) -> int:
        return len(self.shift) + sum(x.nbytes for x in (self.hashes, self.begins, self.sizes, self.items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(start, items) of each occurrence."""
        import bisect

        import xxhash

        digest, m, b, shift, mask = xxhash.xxh64_intdigest, self.length, self.block, self.shift, len(self.shift) - 1
        hashes = memoryview(self.hashes)
        end, n, last = m, len(words), len(hashes)
        while end <= n:
            step = shift[digest(b" ".join(words[end - b : end]), SEED) & mask]
            if step:
                end += step
                continue
            window = b" ".join(words[end - m : end])
            h = digest(window, SEED)
            k, items = bisect.bisect_left(hashes, h), []
            while k < last and hashes[k] == h:
                begin = self.begins[k]
                if self.sizes[k] == len(window) and self.text[begin : begin + len(window)] == window:
                    items.append(self.names[self.items[k]])
                k += 1
            if items:
                yield end - m, items
            end += 1


def matchers(items: list[tuple[str, bytes]], size: int) -> list[Matcher]:
    """Tables of the windows of all items, one for each length of window."""
    import xxhash

    digest = lambda x: xxhash.xxh64_intdigest(x, SEED)
    names = sorted({item for item, _ in items})
    number = {item: k for k, item in enumerate(names)}
    parts, at = [], 0
    found: dict[int, list[np.ndarray]] = defaultdict(list)
    blocks: dict[int, list[np.ndarray]] = defaultdict(list)
    for item, text in items:
        words = words_of(text)
        m = min(size, len(words))
        if not m:
            continue
        b, n = min(BLOCK, m), len(words) - m + 1
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        hashes = np.fromiter((digest(joined[x:y]) for x, y in zip(begins[:n].tolist(), ends[m - 1 :].tolist(), strict=True)), np.uint64, n)
        found[m].append(np.stack([hashes.view(np.int64), at + begins[:n], ends[m - 1 :] - begins[:n], np.full(n, number[item])]))
        # The k-th block is where windows end that begin k + b - m words before, and lies that far from the ends of others.
        own = np.fromiter((digest(joined[x:y]) for x, y in zip(begins[: len(words) - b + 1].tolist(), ends[b - 1 :].tolist(), strict=True)), np.uint64, len(words) - b + 1)
        blocks[m].append(np.stack([own.view(np.int64), np.maximum(m - b - np.arange(len(own)), 0)]))
        parts.append(joined)
        at += len(joined) + 1
    text = b" ".join(parts)
    out = []
    for m in sorted(found):
        hashes, begins, sizes, owners = np.concatenate(found[m], axis=1)
        hashes = hashes.view(np.uint64)
        order = np.lexsort((begins, owners, hashes))
        hashes, begins, sizes, owners = hashes[order], begins[order], sizes[order], owners[order]
        # An item's window that repeats in it is needed once; if its hash is another window's, both stay.
        same = (hashes[1:] == hashes[:-1]) & (owners[1:] == owners[:-1]) & (sizes[1:] == sizes[:-1])
        same = [s and text[begins[k + 1] : begins[k + 1] + sizes[k]] == text[begins[k] : begins[k] + sizes[k]] for k, s in enumerate(same.tolist())]
        keep = ~np.array([False, *same])
        own, shifts = np.concatenate(blocks[m], axis=1)
        slots = 1 << max(10, int(8 * len(own) - 1).bit_length())
        table = np.full(slots, m - min(BLOCK, m) + 1, np.uint8)
        np.minimum.at(table, (own.view(np.uint64) & np.uint64(slots - 1)).astype(np.int64), shifts.astype(np.uint8))
        out.append(Matcher(m, table.tobytes(), hashes[keep], begins[keep], sizes[keep].astype(np.int32), owners[keep].astype(np.int32), text, names))
    return out


def hits(words: list[bytes], tables: list[Matcher]) -> tuple[list[tuple[int, int]], set[str]]:
    """Disjoint hit ranges of words, and the items found."""
    spans, items = [], set()
    for table in tables:
        for start, found in table.search(words):
            spans.append((start, start + table.length))
            items.update(found)
    return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def row(n_words: int, spans: list[tuple[int, int]], items: set[str], least: int) -> tuple[int, int, int, str, bool]:
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return n_words, sum(b - a for a, b in spans), len(items), digest, len(items) >= least


SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())


def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(KINDS)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, KINDS, strict=True))], names=SCHEMA_NAMES)


def _slices(benchmark: DataFrame, size: int, table_bytes: int, text: str, item_id: str) -> tuple[int, Iterator]:
    """How many slices the benchmark is dealt into by a hash, so that the tables of each take about ``table_bytes``, and
    the broadcasts of these tables. An item stays whole."""
    bench = texts(benchmark, item_id, text=text).select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text")).distinct()
    n = (bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * BYTES_FOR_ONE // table_bytes + 1

    def slices():
        for k in range(n):
            part = bench if n == 1 else bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
            yield benchmark.sparkSession.sparkContext.broadcast(matchers([(r.item, r.text.encode()) for r in part.collect()], size))

    return n, slices()


def _found(keyed: DataFrame, slices: Iterator) -> DataFrame:
    """Hit ranges and items of each text with any: (key, spans, items), joined over all slices."""

    def search(shipped):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = shipped.value
            for batch in batches:
                keys, spans, items = [], [], []
                for k, x in zip(batch.column(0), batch.column(1), strict=True):
                    s, i = hits(words_of(x.as_buffer().to_pybytes()), tables)
                    if s:
                        keys.append(k.as_py())
                        spans.append([f"{a}:{b}" for a, b in s])
                        items.append(sorted(i))
                kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((keys, spans, items), kinds, strict=True)], names=["key", "spans", "items"])

        return keyed.select("key", "text").mapInArrow(releasing(run), "key string, spans array<string>, items array<string>")

    parts = [search(x) for x in slices]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # Copies of a text repeat the same sets, which set aggregation folds before the shuffle.
    return found.groupBy("key").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, size: int = 8, least_items: int = 2, table_bytes: int = TABLE_BYTES,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
) -> DataFrame:
    """Words of each document that lie in a window of a benchmark item, and the items with such windows.

    Null and empty texts have no words. A null item_id counts as the item "null"; repeated item rows count once
    for each item_id. Rows with equal doc_id, and repeated rows, are searched each; a null id stays null; other
    columns, whatever their names, play no part; an empty table gives no rows, an empty benchmark hits nothing.
    The benchmark's text is summed first: if its tables take up to ``table_bytes`` it is searched in one pass
    without a shuffle; a larger one is dealt by hash into slices of about that size, each searched in a pass of
    its own over the documents, and the hits of a text are joined over the slices by its hash.
    """
    narrow = texts(docs, doc_id, text=text).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    n_slices, slices = _slices(benchmark, size, table_bytes, text, item_id)
    if n_slices == 1:
        shipped = next(slices)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = shipped.value
            for batch in batches:
                words = (words_of(x.as_buffer().to_pybytes()) for x in batch.column(1))
                yield _batch(batch.column(0), [row(len(w), *hits(w, tables), least_items) for w in words])

        return narrow.mapInArrow(releasing(run), SCHEMA)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(words_of(x.as_buffer().to_pybytes())) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "key", "n"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, s, i in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                rows.append(row(n, merged([tuple(map(int, y.split(":"))) for y in s or []]), set(i or []), least_items))
            yield _batch(batch.column(0), rows)

    keyed = narrow.select("doc_id", F.sha2("text", 256).alias("key"), "text")
    counted = keyed.mapInArrow(releasing(count), "doc_id bigint, key string, n bigint")
    joined = counted.join(_found(keyed, slices), "key", "left").select("doc_id", "n", "spans", "items")
    return joined.mapInArrow(finish, SCHEMA)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = 8, least_items: int = 1, table_bytes: int = TABLE_BYTES, text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """The rows, with all their columns, whatever their names, in which windows of fewer than ``least_items`` items occur.

    Null and empty texts have no words and stay; equal texts stay or go together, and repeated rows stay each. An
    empty benchmark drops nothing; an empty table gives no rows. Slices are as in ``decontaminate``.
    """
    n_slices, slices = _slices(benchmark, size, table_bytes, text, item_id)
    if n_slices == 1:
        shipped, place = next(slices), docs.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = shipped.value
            for batch in batches:
                column = batch.column(place).cast(pa.string())
                found = [len(hits(words_of(x.as_buffer().to_pybytes()), tables)[1]) if x.is_valid else 0 for x in column]
                yield batch.filter(pa.array([n < least_items for n in found], pa.bool_()))

        return docs.mapInArrow(releasing(run), docs.schema)
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keyed = docs.select(F.sha2(whole, 256).alias("key"), whole.alias("text"))
    bad = _found(keyed, slices).where(F.size("items") >= least_items).select(F.col("key").alias("__key"))
    return docs.join(bad, F.sha2(whole, 256) == F.col("__key"), "left_anti")

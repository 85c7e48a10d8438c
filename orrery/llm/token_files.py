"""Token-id files: patched frame-of-reference blocks behind an index, written and read through Spark.

A file is a run of segments, each closed by a line feed (the only byte that Spark's text writer adds).
A segment holds whole documents in ascending order of doc_id; it is closed after the run of texts (ENCODE_BYTES
at most, or one longer text) in which it reaches SEGMENT_TOKENS:

    header   magic, part, number in the part, documents, tokens, blocks   (HEADER, little-endian)
    docs     doc_id int64[documents], tokens uint32[documents]; a null id is flagged by a byte each
    index    byte offset of each block's payload, uint64[blocks + 1]
    blocks   minimum uint32[blocks], width uint8[blocks], exceptions uint8[blocks]
    payload  for each block 128 values less the minimum, their low ``width`` bits packed into 64-bit
             words; then its exceptions: positions uint8[], high bits uint32[]

The width is the one that holds the 90th percentile of a block's residuals; larger ones are patched.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.byte_bpe import Words
from orrery.llm.common import checkpoint, releasing, ship, slices_by_bytes, texts
from orrery.session import scratch

BLOCK = 128
PERCENTILE = 90
HEADER = struct.Struct("<4sIIIQI")
MAGIC = b"PFT1"
#: Tokens after which a segment is closed, and segments in one file.
SEGMENT_TOKENS = 1 << 20
SEGMENTS_A_FILE = 4
#: Bytes of text that are encoded at once: words that repeat in them are looked up once.
ENCODE_BYTES = 8 << 20
#: Bytes after which a worker gives free memory back at the end of a task: each time costs the pages' zeroing anew.
RELEASE_BYTES = 40 << 20


def bit_widths(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned 32-bit value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack_lanes(values: np.ndarray, width: int) -> np.ndarray:
    """128 values of each row, low ``width`` bits each, into 2 * width words of 64 bits."""
    columns = np.ascontiguousarray(values.T).astype(np.uint64)
    words = np.zeros((2 * width, values.shape[0]), np.uint64)
    for j in range(BLOCK if width else 0):
        word, shift = divmod(j * width, 64)
        words[word] |= columns[j] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= columns[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T)


def unpack_lanes(words: np.ndarray, width: int) -> np.ndarray:
    columns = np.ascontiguousarray(words.T)
    values = np.zeros((BLOCK, words.shape[0]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(BLOCK if width else 0):
        word, shift = divmod(j * width, 64)
        x = columns[word] >> np.uint64(shift)
        if shift + width > 64:
            x |= columns[word + 1] << np.uint64(64 - shift)
        values[j] = x & mask
    return np.ascontiguousarray(values.T).astype(np.uint32)


def pack(ids: np.ndarray) -> tuple[bytes, int]:
    """Index, blocks and payload of a run of unsigned 32-bit ids."""
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return np.zeros(1, np.uint64).tobytes(), 0
    rows = np.pad(ids, (0, n_blocks * BLOCK - len(ids)), mode="edge").reshape(n_blocks, BLOCK).astype(np.uint32)
    least = rows.min(1)
    rest = rows - least[:, None]
    cut = BLOCK * PERCENTILE // 100
    width = bit_widths(np.partition(rest, cut, axis=1)[:, cut])
    high = rest >> width[:, None].astype(np.uint32)
    high[width == 32] = 0
    patched = high != 0
    exceptions = patched.sum(1).astype(np.uint8)
    size = 16 * width.astype(np.int64) + 5 * exceptions.astype(np.int64)
    ends = np.cumsum(size)
    payload = np.zeros(int(ends[-1]), np.uint8)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        if w:
            low = rest[at] & np.uint32((1 << w) - 1)
            packed = pack_lanes(low, w).view(np.uint8)
            payload[(ends - size)[at][:, None] + np.arange(16 * w)] = packed
    block, position = np.nonzero(patched)
    if len(block):
        nth = np.arange(len(block)) - (np.cumsum(exceptions, dtype=np.int64) - exceptions)[block]
        base = (ends - size + 16 * width.astype(np.int64))[block]
        payload[base + nth] = position
        payload[(base + exceptions[block] + 4 * nth)[:, None] + np.arange(4)] = high[block, position].astype("<u4").view(np.uint8).reshape(-1, 4)
    index = np.concatenate([[0], ends]).astype("<u8")
    return b"".join([index.tobytes(), least.astype("<u4").tobytes(), width.tobytes(), exceptions.tobytes(), payload.tobytes()]), n_blocks


def unpack(data: memoryview, n_blocks: int, n_tokens: int) -> tuple[np.ndarray, int]:
    """The ids, and how many bytes they took."""
    index = np.frombuffer(data, "<u8", n_blocks + 1).astype(np.int64)
    at = 8 * (n_blocks + 1)
    least = np.frombuffer(data, "<u4", n_blocks, at)
    width = np.frombuffer(data, np.uint8, n_blocks, at + 4 * n_blocks)
    exceptions = np.frombuffer(data, np.uint8, n_blocks, at + 5 * n_blocks)
    at += 6 * n_blocks
    payload = np.frombuffer(data, np.uint8, int(index[-1]), at)
    values = np.zeros((n_blocks, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            packed = payload[index[:-1][rows][:, None] + np.arange(16 * w)]
            values[rows] = unpack_lanes(np.ascontiguousarray(packed).view(np.uint64), w)
    block = np.repeat(np.arange(n_blocks), exceptions)
    if len(block):
        nth = np.arange(len(block)) - (np.cumsum(exceptions, dtype=np.int64) - exceptions)[block]
        base = (index[:-1] + 16 * width.astype(np.int64))[block]
        high = payload[(base + exceptions[block] + 4 * nth)[:, None] + np.arange(4)]
        values[block, payload[base + nth]] |= np.ascontiguousarray(high).view("<u4")[:, 0] << width[block].astype(np.uint32)
    return (values + least[:, None]).ravel()[:n_tokens], at + int(index[-1])


def segment(part: int, number: int, doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> bytes:
    packed, n_blocks = pack(ids)
    absent = doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
    known = pc.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False).astype("<i8")
    head = HEADER.pack(MAGIC, part, number, len(doc_ids), len(ids), n_blocks)
    return b"".join([head, known.tobytes(), absent.tobytes(), counts.astype("<u4").tobytes(), packed])


def read_segments(content: bytes | memoryview) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, number, doc ids, whether null, counts, ids) of each segment of a file."""
    data, at = memoryview(content), 0
    while at < len(data):
        magic, part, number, n_docs, n_tokens, n_blocks = HEADER.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        at += HEADER.size
        doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        absent = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs).astype(bool)
        counts = np.frombuffer(data, "<u4", n_docs, at + 9 * n_docs).astype(np.int64)
        at += 13 * n_docs
        ids, took = unpack(data[at:], n_blocks, n_tokens)
        at += took + 1
        yield part, number, doc_ids, absent, counts, ids


def encode_to_files(docs: DataFrame, vocabulary: str, end_id: int | None, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> str:
    """Encode every text and write the ids in ascending order of doc_id; gives the folder back.

    Rows are dealt by ranges of (doc_id, hash of the text) and sorted by these and the text, so the order of
    equal ids is the same however rows are dealt; a null id sorts first. A null or empty text has the end id
    alone, or nothing where ``end_id`` is None. Repeated rows are written each; other columns play no part; an
    empty table gives a folder without segments. Without ``folder`` the files last as long as the application.
    The text goes through the one shuffle, and the ids never do.
    """
    spark = docs.sparkSession
    shipped, folder = ship(spark, vocabulary), folder or scratch(spark, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, number = Words.of(shipped.value), TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        n = 0

        def close() -> pa.RecordBatch:
            nonlocal number, n
            doc_ids = pa.concat_arrays([x[0] for x in held])
            data = segment(part, number, doc_ids, np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]))
            held.clear()
            number, n = number + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["segment"])

        for batch in batches:
            for at, count in slices_by_bytes(batch.column(1), ENCODE_BYTES):
                rows = batch.slice(at, count)
                ids, counts = words.encode_column(rows.column(1))
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                    counts = counts + 1
                held.append((rows.column(0), counts, ids))
                n += len(ids)
                if n >= SEGMENT_TOKENS:
                    yield close()
        if held:
            yield close()

    narrow = texts(docs, doc_id, text=text).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    keyed = narrow.withColumn("h", F.xxhash64("text"))
    dealt = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    segments = dealt.mapInArrow(releasing(run, RELEASE_BYTES), "segment binary")
    segments.select(F.col("segment").cast("string")).write.option("maxRecordsPerFile", SEGMENTS_A_FILE).text(folder)
    return folder


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Read the files back: a row for each document, with its place among all tokens.

    doc_id, start (tokens of all documents before it in the files' order), n_tokens, ids_crc32
    (unsigned, of its ids as little-endian unsigned 32-bit integers), part, segment, offset (in the segment).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for part, number, doc_ids, absent, counts, ids in read_segments(content.as_buffer()):
                    ends, data = np.cumsum(counts), memoryview(ids.astype("<u4", copy=False)).cast("B")
                    crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(ends), part), pa.int32()), pa.array(np.full(len(ends), number), pa.int32()), pa.array(doc_ids, mask=absent), pa.array(ends - counts), pa.array(counts), pa.array(crcs, pa.int64())],
                        names=["part", "segment", "doc_id", "offset", "n_tokens", "ids_crc32"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    rows = checkpoint(files.mapInArrow(releasing(run), "part int, segment int, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint"))
    # Prefix sums in two steps: within each part over its segments, and over the parts, of which there are as many as shuffle partitions.
    segments = rows.groupBy("part", "segment").agg(F.sum("n_tokens").alias("n"))
    parts = segments.groupBy("part").agg(F.sum("n").alias("n"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before("part")), F.lit(0)).alias("part_start"))
    places = segments.select("part", "segment", F.coalesce(F.sum("n").over(before("part", "segment")), F.lit(0)).alias("in_part")).join(parts, "part")
    return rows.join(places, ["part", "segment"]).select(
        "doc_id", (F.col("part_start") + F.col("in_part") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "part", "segment", "offset"
    )

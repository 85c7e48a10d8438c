"""WARC files with a Merkle fixity audit.

Files hold one gzip member for each record, as is usual for WARC, and one line feed at their end, which
Spark's text writer adds. A replica's tree has one leaf for each record's byte range (the hash of its
stored bytes with the range), inner nodes over FAN ordered neighbours up to the file's root, and above the
files one node for each of 256 buckets of file names and the root. Replicas are compared from the root;
only the children of nodes that differ are compared further. A copy is hashed over the archive's own ranges,
whose lengths are sent to where the copy's files are read; the bytes stay there.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import checkpoint
from orrery.session import scratch

FAN = 16
#: Fixed value: how a deflated gzip member begins.
MAGIC = b"\x1f\x8b\x08"
#: Compressed bytes after which a file is closed.
FILE_BYTES = 8 << 20
#: Records whose lengths are broadcast for one pass over a copy.
MOST_RANGES = 8 << 20
NODES = "file string, level int, idx bigint, begin bigint, end bigint, hash string, page_id bigint, url string"
_BREAKS = re.compile(r"[\x00-\x20\x7f]")


def record(page_id: int | None, url: str | None, body: bytes, date: str, place: str = "") -> bytes:
    """One resource record. White space and controls in the address are escaped; a missing one is named by the page.

    ``place`` tells records of equal pages apart, whose ids have to differ.
    """
    target = _BREAKS.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    digest = hashlib.sha256(body).hexdigest()
    own = uuid.UUID(bytes=hashlib.sha256("\n".join([place, str(page_id), target, digest]).encode("utf-8", "surrogatepass")).digest()[:16], version=5)
    head = (
        f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: {target}\r\nWARC-Date: {date}\r\nWARC-Record-ID: <urn:uuid:{own}>\r\nWARC-Block-Digest: sha256:{digest}\r\n"
        + (f"X-Page-Id: {page_id}\r\n" if page_id is not None else "")
        + f"Content-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return head.encode() + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def unpack_member(view: memoryview, begin: int) -> tuple[int, bytes] | None:
    """Where the member at a byte ends, and its content; None if it is damaged."""
    unpacker, at, parts = zlib.decompressobj(31), begin, []
    try:
        while not unpacker.eof:
            chunk = view[at : at + 4096]
            if not chunk:
                return None
            parts.append(unpacker.decompress(chunk))
            at += len(chunk)
    except zlib.error:
        return None
    return at - len(unpacker.unused_data), b"".join(parts)


def members(data: bytes) -> Iterator[tuple[int, int, bytes | None]]:
    """(offset, length, content) of each member; content is None where it is damaged."""
    view, at, end = memoryview(data), 0, len(data) - data.endswith(b"\n")
    while at < end:
        found = unpack_member(view, at)
        if found:
            yield at, found[0] - at, found[1]
            at = found[0]
            continue
        begin, at = at, at + 1
        while (at := data.find(MAGIC, at, end)) >= 0 and not unpack_member(view, at):
            at += 1
        at = end if at < 0 else at
        yield begin, at - begin, None


def read_record(content: bytes) -> tuple[int | None, str, bytes]:
    """(page id, address, body) of a record's content."""
    head, _, rest = content.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    page = named.get("X-Page-Id")
    return int(page) if page is not None else None, named["WARC-Target-URI"], rest[: int(named["Content-Length"])]


def write_warc(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", body: str = "html", date: str = "1970-01-01T00:00:00Z") -> str:
    """Write every page as a record, in order of page_id (null first) and url; gives the folder.

    A null body is an empty one. Repeated rows are written each, under ids of their own; other columns, whatever
    their names, play no part; an empty table gives no files with records. Without ``folder`` the files last as
    long as the application.
    """
    folder = folder or scratch(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        part, number, size = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for k, u, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(member(record(k, u, (b or "").encode(), date, f"{part}/{number}")))
                number, size = number + 1, size + len(held[-1])
                if size >= FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["file"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["file"])

    narrow = pages.select(F.col(page_id).cast("bigint").alias("a"), F.col(url).cast("string").alias("b"), F.col(body).cast("string").alias("c"))
    dealt = narrow.repartitionByRange("a", "b", F.xxhash64("c")).sortWithinPartitions("a", "b", F.xxhash64("c"))
    _write(dealt.mapInArrow(run, "file binary"), folder)
    return folder


def _write(files: DataFrame, folder: str) -> None:
    files.select(F.col("file").cast("string")).write.option("maxRecordsPerFile", 1).text(folder)


#: A file's name, without what Spark's writer puts into it for each job.
def file_name(path):
    return F.concat_ws("-", F.regexp_extract(path, r"part-(\d+)", 1), F.regexp_extract(path, r"-(c\d+)[^/]*$", 1))


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select(file_name(F.col("path")).alias("file"), "content")


def leaf(data: bytes, begin: int, end: int, upto: int) -> bytes:
    return hashlib.sha256(b"\0" + struct.pack("<QQ", begin, end) + data[begin:upto]).digest()


def tree(data: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int, int, int, bytes]]:
    """(level, index, begin, end, hash) of all nodes over the ranges of a file; the last one is its root.

    Bytes after the last range, but for the writer's line feed, are hashed with it.
    """
    full = len(data) - data.endswith(b"\n")
    nodes = [(0, k, a, b, leaf(data, a, b, b if k < len(ranges) - 1 else max(b, full))) for k, (a, b) in enumerate(ranges)]
    level, out = nodes, list(nodes)
    while len(level) > 1:
        groups = [level[k : k + FAN] for k in range(0, len(level), FAN)]
        level = [(g[0][0] + 1, k, g[0][2], g[-1][3], hashlib.sha256(b"\1" + struct.pack("<QQ", g[0][2], g[-1][3]) + b"".join(x[4] for x in g)).digest()) for k, g in enumerate(groups)]
        out += level
    return out


def _nodes(name: str, data: bytes, ranges: list[tuple[int, int]], pages: list[tuple[int | None, str | None]]) -> pa.RecordBatch:
    found = tree(data, ranges)
    pages = pages + [(None, None)] * (len(found) - len(pages))
    columns = [[name] * len(found), *(list(c) for c in zip(*found, strict=True)), *(list(c) for c in zip(*pages, strict=True))] if found else [[]] * 8
    columns[5] = [d.hex() for d in columns[5]]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in NODES.split(", ")])


def replica_nodes(files: DataFrame) -> DataFrame:
    """All nodes within the files of an archive; leaves have their record's page and address, if it isn't damaged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                ranges, pages = [], []
                for at, n, record_data in members(data):
                    ranges.append((at, at + n))
                    pages.append(read_record(record_data)[:2] if record_data else (None, None))
                yield _nodes(name, data, ranges, pages)

    return files.mapInArrow(run, NODES)


def copy_nodes(files: DataFrame, ours: DataFrame, most: int = MOST_RANGES) -> DataFrame:
    """The same nodes over a copy's files: over the ranges that ``ours`` has for a file of that name, whatever the copy's bytes are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, lengths in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ends = list(accumulate(lengths))
                yield _nodes(name, content.as_py(), list(zip([0, *ends[:-1]], ends, strict=True)), [])

    # Ranges follow one another from a file's first byte, so their lengths tell them.
    length = F.struct("idx", (F.col("end") - F.col("begin")).cast("int").alias("n"))
    leaves = ours.where("level = 0")
    lists = checkpoint(leaves.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(length)), lambda x: x["n"]).alias("lengths")))
    slices, held = [[]], 0  # of names; without any there is nothing to hash
    for name, n in lists.select("file", F.size("lengths")).orderBy("file").collect():
        if slices[-1] and held + n > most:
            slices.append([])
            held = 0
        slices[-1].append(name)
        held += n
    found = [ours.limit(0)]
    for k, names in enumerate(slices if slices[0] else []):
        some = lists if len(slices) == 1 else lists.where(F.col("file") >= names[0]) if k == len(slices) - 1 else lists.where(F.col("file").between(names[0], names[-1]))
        found.append(files.join(F.broadcast(some), "file").select("file", "content", "lengths").mapInArrow(run, NODES))
    return reduce(DataFrame.unionByName, found)


def _upper(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Roots of the files, nodes of the 256 buckets of file names, and the root."""
    files = nodes.groupBy("file").agg(F.max_by("hash", "level").alias("hash"), F.max("level").alias("top")).withColumn("bucket", F.sha2("file", 256).substr(1, 2))
    pair = F.sort_array(F.collect_list(F.concat_ws(":", "file", "hash")))
    buckets = files.groupBy("bucket").agg(F.sha2(F.concat_ws(",", pair), 256).alias("hash"))
    root = buckets.agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(F.concat_ws(":", "bucket", "hash")))), 256).alias("hash"))
    return files, buckets, root


def damaged(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Leaves (file, record) of ours in which the nodes of two replicas differ, by descending only where they do."""
    (files, buckets, root), (files2, buckets2, root2) = _upper(ours), _upper(theirs)
    top = ours.agg(F.max("level")).first()[0]
    if top is None or root.first() == root2.first():
        return ours.select("file", F.col("idx").alias("record")).limit(0)

    def differ(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
        other = b.select(*key, F.col("hash").alias("other"))
        return a.join(other, [*key], "left").where(F.col("other").isNull() | (F.col("hash") != F.col("other"))).drop("other", "hash")

    bad = differ(buckets, buckets2, "bucket")
    bad = differ(files.join(bad, "bucket", "left_semi"), files2, "file").select("file", F.col("top").alias("level"), F.lit(0).cast("bigint").alias("idx"))
    strip = lambda df: df.select("file", "level", "idx", "hash")
    leaves = bad.where("level = 0").select("file", "idx")
    for level in range(top, 0, -1):
        below = strip(ours).where(F.col("level") == level - 1)
        parents = bad.where(F.col("level") == level).select("file", F.col("idx").alias("up"))
        children = below.join(parents, (below.file == parents.file) & (F.floor(below.idx / FAN) == parents.up)).select(below.file, "level", "idx", "hash")
        # Written once: each level would else run all those above it twice.
        worse = checkpoint(differ(children, strip(theirs).where(F.col("level") == level - 1), "file", "level", "idx"))
        bad = bad.unionByName(worse)
        if level == 1:
            leaves = leaves.unionByName(worse.select("file", "idx"))
    return leaves.select("file", F.col("idx").alias("record")).distinct()


def copy_replica(files: DataFrame, change: Callable[[str, bytes], bytes] | None = None, folder: str | None = None) -> str:
    """Write (file, content) again, one file each under its own number; ``change`` damages a copy for a drill.

    Contents end with the writer's line feed, which it adds again. Without files the folder has none.
    """
    folder = folder or scratch(files.sparkSession, "warc-copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                data = change(name, data) if change else data
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data[:-1]], pa.binary())], names=["file", "data"])

    copied = files.mapInArrow(run, "file string, data binary").select("file", F.col("data").cast("string").alias("value"))
    copied.write.partitionBy("file").text(folder)
    return folder


def copied_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content) of a replica that ``copy_replica`` wrote."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(folder)
    return read.select(F.regexp_extract("path", r"file=([^/]+)/", 1).alias("file"), "content")


def audit(files: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record with its range, page, leaf hash, the archive's root, and whether the replica's bytes differ.

    ``files`` and ``replica`` are (file, content); other columns play no part. Records of a file that the replica
    lacks are damaged. A file that only the replica has is a row of its own, damaged, with its name alone and no
    record. An archive without records has the root of no buckets, the hash of nothing. A record is damaged where its range in the replica has
    other bytes or fewer: after a loss or an insertion within a file that is every record that no longer stands
    at its offset. What follows a file's last record, appended records too, counts as its.
    """
    files, replica = files.select("file", "content"), replica.select("file", "content")
    ours = checkpoint(replica_nodes(files))
    theirs = checkpoint(copy_nodes(replica, ours).drop("page_id", "url"))
    root = _upper(ours)[2].first()["hash"]
    bad = damaged(ours, theirs).withColumn("damaged", F.lit(True))
    leaves = ours.where("level = 0").select("file", F.col("idx").alias("record"), F.col("begin").alias("offset"), (F.col("end") - F.col("begin")).alias("length"), "page_id", "url", F.col("hash").alias("leaf_sha256"))
    joined = leaves.join(bad, ["file", "record"], "left").withColumn("damaged", F.coalesce("damaged", F.lit(False)))
    surplus = replica.select("file").distinct().join(files.select("file").distinct(), "file", "left_anti").withColumn("damaged", F.lit(True))
    rows = joined.unionByName(surplus, allowMissingColumns=True)
    return rows.select("file", "record", "offset", "length", "page_id", "url", "leaf_sha256", F.lit(root).alias("root_sha256"), "damaged")

"""The audit against damage that members don't survive one by one."""

import hashlib
import struct
import zlib

import pytest

from orrery.llm import queries, warc


@pytest.fixture(scope="module")
def files(spark):
    rows = [(k, f"http://x/{k}", f"<p>{k} {'word ' * (k % 9)}</p>") for k in range(300)]
    return warc.files_of(spark, warc.write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1))).cache()


def flip(places):
    def change(name, data):
        changed, found = bytearray(data), list(warc.members(data))
        for k, where in places:
            at, n, _ = found[k]
            changed[at + (0 if where == "begin" else n - 1 if where == "end" else n // 2)] ^= 1
        return bytes(changed)

    return change


def cut(name, data):
    at, n, _ = list(warc.members(data))[-3]
    return data[: at + n // 2] + b"\n"


CASES = {
    "adjacent": (flip([(2, "mid"), (3, "mid")]), lambda k, n: k in (2, 3)),
    "boundary": (flip([(4, "end"), (5, "begin")]), lambda k, n: k in (4, 5)),
    "first and last": (flip([(0, "begin"), (-1, "end")]), lambda k, n: k in (0, n - 1)),
    "truncated": (cut, lambda k, n: k >= n - 3),
    "surplus": (lambda name, data: data[:-1] + b"more\n", lambda k, n: k == n - 1),
    "emptied": (lambda name, data: b"\n", lambda k, n: True),
}


@pytest.mark.parametrize("case", CASES)
def test_audit_locates(spark, files, case):
    change, expected = CASES[case]
    got = warc.audit(files, warc.copied_files(spark, warc.copy_replica(files, change))).toPandas()
    n = got.groupby("file").record.transform("count")
    assert (n > 8).all() and len(got) == 300
    assert got.damaged.tolist() == [expected(k, m) for k, m in zip(got.record, n, strict=True)]


def test_lengths_in_slices(spark, files):
    ours = warc.replica_nodes(files)
    for most in (1, 100, 10_000):
        assert sorted(map(tuple, warc.copy_nodes(files, ours, most).drop("page_id", "url").collect())) == sorted(map(tuple, ours.drop("page_id", "url").collect()))


def test_drill_is_located(spark, files):
    got = warc.audit(files, warc.copied_files(spark, warc.copy_replica(files, queries.damage))).toPandas()
    last = got.groupby("file").record.transform("max")
    number = got.file.str.split("-").str[0].astype(int) % 4
    half = queries.DRILL // 2
    assert (got.damaged == ((got.record % queries.DRILL < 2) | (((got.record % queries.DRILL == half) & (got.record < last)) | ((got.record % queries.DRILL == half + 1))) | ((got.record == last) & number.isin([1, 2])))).all()


def test_every_hash_by_plain_python(spark, files):
    """Offsets, leaves, the tree of every file and the root, recomputed from the bytes."""
    got = warc.audit(files, files).toPandas()
    assert not got.damaged.any()
    buckets = {}
    for row in files.collect():
        data, at, leaves = bytes(row.content), 0, []
        while at < len(data) - 1:
            unpacker = zlib.decompressobj(31)
            unpacker.decompress(data[at:])
            end = len(data) - len(unpacker.unused_data)
            leaves.append((at, end, hashlib.sha256(b"\0" + struct.pack("<QQ", at, end) + data[at:end]).digest()))
            at = end
        own = got[got.file == row.file].sort_values("record")
        assert list(zip(own.offset, own.offset + own.length, own.leaf_sha256, strict=True)) == [(a, b, h.hex()) for a, b, h in leaves]
        level = leaves
        while len(level) > 1:
            groups = [level[k : k + 16] for k in range(0, len(level), 16)]
            level = [(g[0][0], g[-1][1], hashlib.sha256(b"\1" + struct.pack("<QQ", g[0][0], g[-1][1]) + b"".join(x[2] for x in g)).digest()) for g in groups]
        buckets.setdefault(hashlib.sha256(row.file.encode()).hexdigest()[:2], []).append(f"{row.file}:{level[0][2].hex()}")
    joined = sorted(f"{k}:{hashlib.sha256(','.join(sorted(v)).encode()).hexdigest()}" for k, v in buckets.items())
    assert set(got.root_sha256) == {hashlib.sha256(",".join(joined).encode()).hexdigest()}


def test_records_have_ids_of_their_own(spark):
    rows = [(1, "http://x/", "same")] * 40 + [(None, None, None)] * 3
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = [c for r in warc.files_of(spark, warc.write_warc(pages)).collect() for *_, c in warc.members(r.content)]
    ids = [line for c in found for line in c.split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(ids) == 43 == len(set(ids))
    assert sorted(map(repr, (warc.read_record(c) for c in found))) == sorted(map(repr, [(1, "http://x/", b"same")] * 40 + [(None, "urn:page:None", b"")] * 3))


def test_missing_surplus_and_empty(spark, files):
    names = sorted(r.file for r in files.select("file").collect())
    half = files.where(files.file <= names[len(names) // 2])
    less = warc.audit(files, half).toPandas()
    assert (less.damaged == (less.file > names[len(names) // 2])).all() and len(less) == 300
    more = warc.audit(half, files.withColumn("page_id", files.file)).toPandas()
    assert set(more[more.damaged].file) == set(names[len(names) // 2 + 1 :]) and more[more.damaged].record.isna().all() and not more[more.record.notna()].damaged.any()
    none = files.limit(0)
    assert warc.audit(none, none).count() == 0
    assert {(r.file, r.record, r.damaged, r.root_sha256) for r in warc.audit(none, files).collect()} == {(n, None, True, hashlib.sha256(b"").hexdigest()) for n in names}
    assert warc.audit(files, none).where("not damaged").count() == 0
    empty = spark.createDataFrame([], "page_id bigint, url string, html string, damaged string")
    assert warc.audit(warc.files_of(spark, warc.write_warc(empty)), none).count() == 0


def test_awkward_pages(spark):
    long = "x" * 3_000_000
    pages = spark.createDataFrame([(1, "u", long, "a", 1), (None, "a b\r\nX: y", "é", None, 2), (2, None, None, "b", None)], "page_id bigint, url string, html string, file string, record int")
    files = warc.files_of(spark, warc.write_warc(pages))
    got = warc.audit(files, files).collect()
    assert sorted((r.page_id, r.url) for r in got if r.page_id is not None) == [(1, "u"), (2, "urn:page:2")] and len(got) == 3
    bodies = {warc.read_record(c)[2] for r in files.collect() for *_, c in warc.members(r.content)}
    assert bodies == {long.encode(), "é".encode(), b""}

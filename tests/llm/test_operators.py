"""Each operator against a brute-force version, a library or a round trip, over awkward rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from orrery.llm import (
    byte_bpe, components, decontaminate, html_extract, html_pages, pieces, quality, simhash, token_counts, token_files, vector_search, warc,
)

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "\n", "a", "The quick brown fox, it's 12.5% done.", "The quick brown fox, it's 12.5% done.", "two  spaces\tand tab ", "x\n\ny", "日本語 テスト 😀",
    "word " * 20_000, "<|endoftext|> inside", "é" * 300, "ab\ncd ef\ngh", "▁mark", " nbsp  x", "secret=hunter2hunter2",
]
ROWS = [(k if k != 4 else None, t, "other", 1.5) for k, t in enumerate(TEXTS)] + [(1, "", "again", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, score string, n_tokens double")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def key(row):
    return repr(row)


def test_token_counts_match_the_library(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    want = sorted(((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ROWS), key=key)
    got = token_counts.count_tokens(docs, BPE).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.count_tokens(none, BPE).count() == 0


def test_piece_counts_match_the_library(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.count_tokens(docs, PIECES).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=key) == sorted(((i, len(sp.encode(t or ""))) for i, t, *_ in ROWS), key=key)


@pytest.mark.parametrize("path", [BPE, PIECES])
def test_proven_tokens_are_whole(path):
    import sentencepiece
    from tokenizers import Tokenizer

    some = sorted(token_counts.proven(path))[::50]
    assert len(some) > 400
    if path == BPE:
        assert all(len(x.ids) == 1 for x in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False))
    else:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        assert all(len(sp.encode(x[1:])) == 1 for x in some if x[:1] == " ")


@pytest.mark.parametrize("path", [BPE, PIECES])
def test_counts_of_random_texts(spark, path):
    import random

    import sentencepiece
    from tokenizers import Tokenizer

    dice = random.Random(12)
    words = ["the", "of", "Straße", "x1", "don't", "日本", "....", "a,b", "é", "\n", "  ", "token.", "ing", "<s>", "▁"]
    strings = ["".join(dice.choice(words) + dice.choice(["", " ", " ", "\n"]) for _ in range(dice.randint(0, 30))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(strings)), "doc_id bigint, text string")
    got = [r.n_tokens for r in token_counts.count_tokens(docs, path).orderBy("doc_id").collect()]
    if path == BPE:
        tok = Tokenizer.from_file(path)
        assert got == [len(x.ids) for x in tok.encode_batch(strings, add_special_tokens=False)]
    else:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        assert got == [len(sp.encode(s)) for s in strings]


def test_word_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(byte_bpe.Words, "most_words", 50)
    words = byte_bpe.Words(open(BPE, "rb").read())
    for k in range(4):
        texts = [f"alpha{k} beta{j}, gamma{j * k}." for j in range(40)]
        ids, counts = words.encode_column(pa.array(texts))
        assert ids.tolist() == [i for x in words.encode(texts) for i in x]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 4000])
@pytest.mark.parametrize("top", [1, 2, 300, 50_257, 2**32 - 1])
def test_blocks_round_trip(n, top):
    rng = np.random.default_rng(n)
    x = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    x[rng.random(n) < 0.03] = 2**32 - 1
    data, blocks = token_files.pack(x)
    got, took = token_files.unpack(memoryview(data), blocks, n)
    assert (got == x).all() and took == len(data)


def test_token_files_round_trip(spark, docs, none, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", 40)
    tok = Tokenizer.from_file(BPE)
    got = token_files.read_token_files(spark, token_files.encode_to_files(docs, BPE, 2)).orderBy("start").collect()
    of = lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 2]
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.doc_id for r in got] == [w[0] for w in want]
    assert [r.n_tokens for r in got] == [len(of(w[1])) for w in want]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(of(w[1]), "<u4").tobytes()) for w in want]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert token_files.read_token_files(spark, token_files.encode_to_files(none, BPE, 2)).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


def test_near_duplicates(spark, docs, none):
    rows = [r for r in ROWS if len(r[1] or "") < 5000]
    got = simhash.near_duplicates(docs.where("text is null or length(text) < 5000")).collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(fps)
    least = {k: min((r[0] for r, x in zip(rows, roots, strict=True) if x == k and r[0] is not None), default=None) for k in roots}
    want = [(r[0], f"{f:016x}", least[x]) for r, f, x in zip(rows, fps, roots, strict=True)]
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns
    assert kept.count() == simhash.near_duplicates(docs).select("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint"))).distinct().count()


@pytest.mark.parametrize("most", [8192, 2])
def test_links_connect_what_all_pairs_connect(spark, most):
    rng = np.random.default_rng(3)
    fps = set()
    for centre in rng.integers(0, 2**63, 5, dtype=np.uint64):
        y = int(centre)
        for _ in range(25):
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                y ^= 1 << int(b)
            fps.add(y)
    fps = sorted(fps)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    linked = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), most)
    found = components.components(linked, most_broadcast=0 if most == 2 else 500_000).collect()
    root = {r.node: r.root for r in found}
    labels = [root.get(x, x) for x in signed]
    want = brute_components(fps)
    assert len(set(zip(labels, want, strict=True))) == len(set(labels)) == len(set(want))


def test_runs_over_batches():
    fps = np.arange(40, dtype=np.int64)
    keys = np.repeat([1, 2, 3, 4], [1, 30, 2, 7])
    whole = [pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps)], names=["key", "fp"])]
    cut = [pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.array(fps[a:b])], names=["key", "fp"]) for a, b in pairwise([0, 1, 2, 20, 32, 33, 40])]
    edges = [sorted((min(p), max(p)) for b in simhash.link_runs(iter(x)) for p in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True)) for x in (whole, cut)]
    joined = [brute_groups(e) for e in edges]
    assert joined[0] == joined[1]


def brute_groups(edges):
    groups = []
    for a, b in edges:
        hit = [g for g in groups if a in g or b in g]
        groups = [g for g in groups if g not in hit] + [set.union({a, b}, *hit)]
    return sorted(map(sorted, groups))


def test_html_on_unseen_layouts():
    model = html_extract.default_model()
    wrong = total = 0
    for page in html_pages.labelled_pages(60, seed=77):
        nodes = html_extract.parse(page, labelled=True)
        belief, _ = model.marginals(nodes)
        for node, p in zip(nodes, belief, strict=True):
            if node.tag == "#" and node.text.strip():
                total += 1
                wrong += (p > 0.5) != node.label
    assert wrong / total < 0.02


def test_marginals_are_exact():
    model = html_extract.default_model()
    nodes = html_extract.parse("<body><div class=ad>x</div><article><p>y</p></article></body>")
    belief, _ = model.marginals(nodes)
    unary = [sum(model.weights.get(f, 0.0) for f in html_extract.traits(nodes, k)) for k in range(len(nodes))]
    total, one = 0.0, np.zeros(len(nodes))
    for state in range(2 ** len(nodes)):
        s = [state >> k & 1 for k in range(len(nodes))]
        w = np.exp(sum(u for u, x in zip(unary, s, strict=True) if x) + sum(model.edges[html_extract.kind(n)][s[n.parent]][s[k]] for k, n in enumerate(nodes) if k))
        total += w
        one += w * np.array(s)
    assert np.allclose(belief, one / total, atol=1e-9)


def test_html_rows(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One\n  two<br>three <b>bold</b>ly.<p>It&#39;s &lt;fine&gt;<script>var t='</p>';</script></article><footer>&copy; me</footer>"
    rows = [(1, "u", page, 3), (None, None, None, 1), (2, "v", "", None), (1, "u", page, 3), (3, "w", "<p title='it", 1), (4, "x", "<div>" * 3000 + "deep", 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_extract.extract(df).collect()), key=key)
    text = "A & B One two three boldly. It's <fine>"
    assert [g for g in got if g[0] == 1] == [(1, text, len(text))] * 2
    assert (2, "", 0) in got and (None, "", 0) in got and len(got) == 6
    assert html_extract.extract(df.limit(0)).count() == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(documents, labels)
    got = quality.score(documents, model).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got.score >= 0.3) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    assert (got.predicted == got.quality).mean() > 0.95
    up, down = got.score[got.quality == 1], got.score[got.quality == 0]
    assert np.mean([[a > b for b in down] for a in up]) > 0.97


def test_quality_of_awkward_rows(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, empty)
    assert quality.score(docs, model).count() == len(ROWS) and quality.score(none, model).count() == 0
    assert quality.keep_good(docs, model).columns == docs.columns
    one = spark.createDataFrame([(k, 1) for k in range(5, 15)] + [(None, 0), (6, None)], "doc_id bigint, quality int")
    assert all(0 <= r.score <= 1 for r in quality.score(docs, quality.train(docs, one)).collect())
    want = {i for i, *_ in ROWS if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    assert {r.doc_id for r in quality.score(docs, model).where("held_out").collect()} == want


def test_dual_coordinate_descent_separates():
    cols = np.array([0, 1, 0, 2, 3, 1, 3, 2])
    w, bias = quality.dual_coordinate_descent(np.array([0, 2, 4, 6, 8]), cols, np.ones(8), np.array([1, 1, -1, -1]), rounds=50)
    assert [np.sign(w[cols[a : a + 2]].sum() + bias) for a in (0, 2, 4, 6)] == [1, 1, -1, -1]


def test_warc_audit_finds_the_damage(spark):
    rows = [(k, f"http://x/{k}", "<p>" + "text " * (k % 7)) for k in range(60)] + [(None, "a b\r\nX: y", None), (5, "http://x/5", "again"), (None, None, "")]
    files = warc.files_of(spark, warc.write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string")))

    def change(name, data):
        spoilt = bytearray(data)
        for k, (at, n, _) in enumerate(warc.members(data)):
            if k in (1, 4):
                spoilt[at + (0 if k == 4 else n // 2)] ^= 255
        return bytes(spoilt)

    got = warc.audit(files, warc.copied_files(spark, warc.copy_replica(files, change))).toPandas()
    assert len(got) == len(rows)
    assert (got.damaged == got.record.isin([1, 4])).all()
    assert not warc.audit(files, warc.copied_files(spark, warc.copy_replica(files))).toPandas().damaged.any()
    assert sorted(got.page_id.dropna()) == sorted([*range(60), 5])


def test_warc_records_round_trip():
    data = b"".join(warc.member(warc.record(k, "http://x/é", b"\r\n\r\nbody\xff" * k, "1970-01-01T00:00:00Z")) for k in range(4)) + b"\n"
    assert [warc.read_record(x) for *_, x in warc.members(data)] == [(k, "http://x/é", b"\r\n\r\nbody\xff" * k) for k in range(4)]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items):
    low = lambda s: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    words, hit, found = low(text), set(), set()
    for item, t in items:
        own = low(t)
        m = min(8, len(own))
        for at in range(len(own) - m + 1 if m else 0):
            for k in range(len(words) - m + 1):
                if words[k : k + m] == own[at : at + m]:
                    hit |= set(range(k, k + m))
                    found.add(item if item is not None else "null")
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2


@pytest.mark.parametrize("size", [128 << 20, 1000])
def test_decontamination(spark, size):
    passage = "one two three four five six seven eight nine ten"
    items = [("10", passage), ("9", "Short item."), (None, "null id"), ("9", "Short item."), ("7", None), ("6", "..."), ("5", "été 1 ΑΒ")]
    texts = [f"x {passage.upper()}! y", passage + " " + passage, "one two three four five six seven", "a short ITEM and null-id", None, "", "été 1 ΑΒ", "short", "eight " * 30, f"x {passage.upper()}! y"]
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.decontaminate(df, bench, table_bytes=size).collect()}
    assert got == {k: brute_hits(t, items) for k, t in enumerate(texts)}
    kept = decontaminate.drop_contaminated(df, bench, table_bytes=size).collect()
    assert sorted(r.doc_id for r in kept) == [k for k, t in enumerate(texts) if brute_hits(t, items)[2] == 0]
    assert decontaminate.decontaminate(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_windows_of_random_words():
    """Few words, so that blocks and windows repeat within items, between them and in the texts."""
    import random

    dice = random.Random(9)
    text = lambda n: " ".join(dice.choices(["a", "b", "c", "dd"], k=n))
    items = [(str(k), text(dice.choice((0, 1, 2, 3, 7, 8, 9, 15)))) for k in range(30)]
    tables = decontaminate.matchers([(i, t.encode()) for i, t in items], 8)
    for n in (0, 1, 5, 8, 40, 200):
        words = text(n)
        spans, found = decontaminate.hits(decontaminate.words_of(words.encode()), tables)
        assert (sum(b - a for a, b in spans), len(found)) == brute_hits(words, items)[1:3]


def test_tables_take_the_bytes_that_bound_them():
    import random

    dice = random.Random(2)
    items = [(str(k), " ".join(dice.choices("abcdefghijklmnopqrstuvwxyz", k=3000)).encode()) for k in range(20)]
    tables = decontaminate.matchers(items, 8)
    size = sum(len(t) for _, t in items)
    assert sum(t.nbytes for t in tables) + len(tables[0].text) <= decontaminate.BYTES_FOR_ONE * size


def test_vector_search(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 12))
    x[17] = x[40]
    rows = [(k, v.astype(np.float32).tolist(), "q") for k, v in enumerate(x)]
    rows += [(400, None, "q"), (420, [0.0] * 12, "q"), (440, [None, *[1.0] * 11], "q"), (460, [float("inf")] * 12, "q"), (480, [1.0, 2.0], "q"), (None, [1.0] * 12, "q"), (500, [], "q"), (20, rows[20][1], "q")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank string")
    good = [(k, np.array(v, float)) for k, v, _ in rows if k is not None and v and len(v) == 12 and None not in v and np.isfinite(v).all() and np.any(v)]
    want = []
    for q, v in good:
        if q % 20 == 0:
            found = sorted((-float(v @ c), k) for k, c in good if k != q)[:20]
            want += [(q, r + 1, k) for r, (s, k) in enumerate(found)]
    for block_bytes in (48 << 20, 500):
        got = vector_search.nearest(df, F.col("vec_id") % 20 == 0, 20, block_bytes=block_bytes).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(want)
    assert vector_search.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = vector_search.nearest(df.where("vec_id in (0, 1, 480)"), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 1)]


def test_wide_vectors_keep_their_bounds():
    """Vectors of one sign, whose sums of code products exceed what single precision holds exactly."""
    rng = np.random.default_rng(1)
    x, k = np.abs(rng.normal(size=(300, 3000))) + 5, 5
    block = vector_search.Block(np.arange(40), np.arange(40), x[:40], k, np.full(40, -np.inf))
    block.meet(np.arange(300), x)
    scores = x[:40] @ x.T
    scores[np.arange(40), np.arange(40)] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :k].tolist()
    assert [[-v for _, v in sorted(h, reverse=True)] for h in block.heaps] == want


def test_pieces_match_the_library(spark, docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = pieces.encode_pieces(docs, PIECES, "doc_id").collect()
    assert sorted(((r.doc_id, list(r.ids), r.decoded) for r in got), key=key) == sorted(((i, sp.encode(t or ""), sp.decode(sp.encode(t or ""))) for i, t, *_ in ROWS), key=key)
    assert all(r.round_trip for r in got) and pieces.encode_pieces(none, PIECES, "doc_id").count() == 0


def test_pieces_of_random_strings():
    import random

    import sentencepiece

    sp, transducer, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.Transducer.of(open(PIECES, "rb").read()), random.Random(4)
    strings = ["".join(rng.choice("abcdeth  \n▁é.=日-0") for _ in range(rng.randint(1, 40))) for _ in range(800)]
    ids, counts = transducer.encode_column(pa.array(strings))
    assert ids.tolist() == [i for s in strings for i in sp.encode(s)] and counts.tolist() == [len(sp.encode(s)) for s in strings]
    assert transducer.decode_column(ids, counts).to_pylist() == [sp.decode(sp.encode(s)) for s in strings]
    assert transducer.decode_column(np.array([transducer.bytes[0xE2]]), np.array([1])).to_pylist() == ["�"]

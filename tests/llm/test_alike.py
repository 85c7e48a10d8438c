"""Near-duplicates by Jaccard similarity, against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import alike, common, components, simhash
from orrery.llm.simhash import keep_one


def brute_sets(text):
    words = (text or "").encode().translate(alike.LOWER).split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def brute_kept(rows):
    """The least id of each component of the pairs of 0.8 or more."""
    sets, root = [brute_sets(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(rows[k][0] for k in range(len(rows)) if find(k) == k)


@pytest.fixture(scope="module")
def rows():
    dice = random.Random(7)
    word = lambda: "".join(dice.choices("abcdefgh", k=5))
    common = [word() for _ in range(60)]
    texts = [None, "", "  ", "one two", "One  TWO", "one two three"]
    for n, copies, most in ((40, 10, 3), (100, 40, 6), (400, 20, 30)):
        base = [word() for _ in range(n)]
        for _ in range(copies):
            words = list(base)
            for at in dice.sample(range(n), dice.randint(0, most)):
                words[at] = word()
            texts.append(" ".join(words))
    # Long passages that many unlike texts share.
    texts += [" ".join(common + [word() for _ in range(dice.randint(5, 40))]) for _ in range(40)]
    return list(enumerate(texts))


@pytest.mark.parametrize("limits", [{}, {"most_in_key": 2}, {"most_in_part": 300}, {"most_in_key": 2, "most_in_part": 500, "sample": 1}])
def test_groups_are_those_of_all_pairs(spark, rows, limits):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = keep_one(docs, alike.similar_groups(docs, **limits))
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)


def test_stage_drops_copies_of_few_changed_words(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = corpus_pipeline.near_duplicate(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.near_duplicate(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(sorted((r.doc_id, r.text) for r in docs.collect()))


def test_runs_over_batches():
    keys = [1, 1, 1, 2, 3, 3, 4, 4, 4, 4, 5]
    whole = pa.RecordBatch.from_arrays([pa.array(keys), pa.array([7] * 11), pa.array(range(11))], names=["a", "b", "c"])
    for cuts in ([], [1], [3], [3, 4], [0, 2, 5, 5, 8], list(range(11))):
        edges = [0, *cuts, 11]
        parts = [whole.slice(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        assert [r.column(2).to_pylist() for r in common.runs(iter(parts), 2)] == [[0, 1, 2], [3], [4, 5], [6, 7, 8, 9], [10]]


def test_awkward_rows(spark):
    long = " ".join(str(k % 9973) for k in range(60_000))
    rows = [(None, "a b c d e f", "x", 1), (None, "a b c d e f", "y", 2), (3, None, "x", None), (2, "", None, 1), (2, "", None, 1), (5, long, "x", 1), (4, long, "x", 2), (4, long, "w", 2), (6, "日本語" * 50, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string, `h` int")
    kept = corpus_pipeline.near_duplicate(spark, docs, "")
    assert kept.schema == docs.schema
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id if r.doc_id is not None else None) for r in kept.collect())
    assert [g[:2] for g in got] == [(False, 2), (False, 4), (False, 6), (True, 0)] and kept.where("doc_id = 4").count() == 1
    again = corpus_pipeline.near_duplicate(spark, docs.repartition(5), "")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, kept.collect()))
    assert corpus_pipeline.near_duplicate(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("most", [3, 100])
def test_memberships_over_batches(most):
    dice = random.Random(4)
    keys = sorted(k for k in range(60) for _ in range(dice.choice((1, 1, 2, 3, 5, 9))))
    h = [dice.randrange(-(2**62), 2**62) for _ in keys]
    rows = sorted(zip(keys, h, strict=True))
    whole = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([x for _, x in rows])], names=["key", "h"])
    groups = [[x for k, x in rows if k == key] for key in sorted(set(keys))]
    want = sorted(sorted(g) for g in groups if len(g) > 1)
    for cuts in ([], [5, 6, 7], sorted(dice.sample(range(len(rows)), 20)), list(range(len(rows)))):
        edges = [0, *cuts, len(rows)]
        parts = [whole.slice(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        found = {}
        for batch in alike.memberships(iter(parts), most):
            for who, x, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                assert (who is None) != (least is None)
                found.setdefault((who, least), []).append(x)
        assert sorted(map(sorted, found.values())) == want
        assert all((who is None) == (len(g) > most) and (least is None or least == min(g)) for (who, least), g in found.items())


def test_parities_never_rule_out_what_is_alike():
    """Sets of many sizes, sizes on either side of a power of two among them."""
    dice = random.Random(6)
    rows = []
    for n in (1, 2, 3, 50, 63, 64, 65, 127, 128, 129, 1000):
        base = [dice.randrange(-(2**62), 2**62) for _ in range(n)]
        for change in (0, n // 20, n // 12, n // 9, n // 3):
            rows.append(np.unique(base[change:] + [dice.randrange(-(2**62), 2**62) for _ in range(change // 2)]) if n > change else np.array(base))
    bits = [alike.parities(r) for r in rows]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(rows)), pa.array(range(len(rows))), pa.array([len(r) for r in rows], pa.int32()), pa.array(bits, pa.binary())], names=["who", "h", "n", "bits"])
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for out in alike.may_be_alike(iter([batch]), 0.8):
        for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
            root[find(a)] = find(b)
    sets = [set(r.tolist()) for r in rows]
    alike_pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(alike_pairs) > 30 and all(find(i) == find(j) for i, j in alike_pairs)
    far = [alike.parities(np.array([dice.randrange(-(2**62), 2**62) for _ in range(n)])) for n in (300, 300, 3000, 3000)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 2, 2]), pa.array([1, 2, 3, 4]), pa.array([300, 300, 3000, 3000], pa.int32()), pa.array(far, pa.binary())], names=["who", "h", "n", "bits"])
    assert not list(alike.may_be_alike(iter([batch]), 0.8))


def shuffled(spark):
    """Bytes that this application has shuffled so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_shared_passages_ship_no_parities(spark):
    """Long texts that only share passages: their parities went with each shared key before."""
    dice = random.Random(8)
    word = lambda: "".join(dice.choices("abcdefghijklmnop", k=6))
    passages = [" ".join(word() for _ in range(20)) for _ in range(40)]
    texts = [" ".join(x for p in dice.sample(passages, 30) for x in [*(word() for _ in range(80)), p]) for _ in range(150)]
    copy = texts[7].split()
    copy[5::100] = [word() for _ in copy[5::100]]
    rows = list(enumerate([*texts, " ".join(copy)]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    before = shuffled(spark)
    found = {r.doc_id: r.component_id for r in alike.similar_groups(docs, sample=5).collect()}
    assert shuffled(spark) - before < 1.25 * sum(len(t) for _, t in rows)
    assert found == {k: 7 if k == 150 else k for k, _ in rows}


def test_widest_groups_hold_every_pair(spark):
    dice = random.Random(9)
    groups = [sorted(dice.sample(range(12), dice.choice((1, 2, 3, 4, 6)))) for _ in range(60)]
    groups += [groups[0], groups[1], list(range(20, 26)), [20, 21], [21, 22, 23], [20, 21]]
    members = spark.createDataFrame([(who, h) for who, g in enumerate(groups) for h in g], "who bigint, h bigint")
    left = {}
    for r in alike.widest(members).collect():
        left.setdefault(r.who, []).append(r.h)
    assert all(sorted(hs) == groups[who] for who, hs in left.items())
    pairs = lambda found: {(a, b) for g in found for a in g for b in g if a < b}
    assert pairs(left.values()) == pairs(groups) and len(left) < len(groups) - 5
    assert [sorted(g) for g in left.values() if min(g) >= 20] == [list(range(20, 26))]


def test_prefixes_share_as_many_as_asked(spark):
    """Sets at and above the similarity, in an order by weights: each shares what least_shared asks for with the other."""
    dice = random.Random(10)
    none, sizes, shared = np.zeros(0, np.int64), [], []
    for n in [*range(1, 60), 99, 100, 101, 399, 400, 1000]:
        for drop in {0, n // 20, n // 10, n // 9, n // 5}:
            a = [dice.randrange(2**62) for _ in range(n)]
            for b in (a[drop:], a[drop // 2 :] + [dice.randrange(2**62) for _ in range(drop // 2)]):
                if len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.8:
                    kept = [alike.prefix(k := np.array(sorted(x), np.int64), k % 7, none, none, 0.8)[0] for x in (a, b)]
                    sizes.append((len(a), len(b)))
                    shared.append(len(np.intersect1d(*kept)))
    asked = [r[:] for r in spark.createDataFrame(sizes, "a int, b int").select(alike.least_shared(F.col("a"), 0.8), alike.least_shared(F.col("b"), 0.8)).collect()]
    assert len(shared) > 200 and all(n >= max(need) for n, need in zip(shared, asked, strict=True))
    assert max(max(need) for need in asked) > 30


def test_stage_goes_through_simhash(spark, rows, monkeypatch):
    """All texts' fingerprints of five words go through the operator's blocks and distances."""
    seen, whole = [], simhash.links

    def spied(fps, *args):
        seen.append(sorted(r.fp for r in fps.collect()))
        return whole(fps, *args)

    monkeypatch.setattr(simhash, "links", spied)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = corpus_pipeline.near_duplicate(spark, docs, "")
    want = {simhash.fingerprint((t or "").encode(), 5) for _, t in rows}
    assert seen == [sorted(np.array(sorted(want), np.uint64).view(np.int64).tolist())]
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)


def test_fingerprints_connect_texts(spark):
    """Texts within four bits, step by step, are one component."""
    fps = {10: 0, 11: 0b111, 12: 0b1111111, 13: -(1 << 63), 14: 0b11 << 40, 15: 0b11 << 40, 16: -1, 17: ~(0b1111 << 30), 18: 0x5555555555555555}
    near = alike.by_fingerprint(spark.createDataFrame(list(fps.items()), "h bigint, fp bigint"))
    found = sorted((r.node, r.root) for r in components.components(near).collect())
    assert found == [(10, 10), (11, 10), (12, 10), (13, 10), (14, 10), (15, 10), (16, 16), (17, 16)]

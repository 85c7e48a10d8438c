"""The pipeline against a brute-force version of its stages, and its stages on awkward rows."""

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import quality, secrets
from tests.llm.test_alike import brute_kept
from tests.llm.test_operators import brute_hits

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_pipeline(spark):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.score(docs, quality.train(docs, labels)).where("predicted = 1").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in good)
    one = set(brute_kept(rows))
    rows = [r for r in rows if r[0] in one]
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if not brute_hits(r[1], bench)[2]]
    assert sorted(got) == [r[0] for r in rows]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    novelty = secrets.Novelty(*secrets.identifier_dictionary(VOCABULARY))
    for doc_id, text in rows:
        assert list(got[doc_id].ids) == sp.encode(secrets.redact(text, secrets.secret_spans(text, novelty)))
    assert all(r.round_trip for r in got.values())


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, columns with clashing names."""
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    long = " ".join(f"w{k % 997}" for k in range(150_000))
    rows = [(None, None, None, None, None), (None, "", "en", "web", 0), (7_000_001, None, "en", None, 5), (7_000_002, long, None, "web", len(long)), (7_000_002, long, None, "web", len(long)), (7_000_003, "", "de", "x", 0)]
    docs = base.unionByName(spark.createDataFrame(rows, base.schema))
    return docs.withColumns({"score": F.lit("s"), "component_id": F.lit(1), "key": F.lit("k"), "h": F.lit(2.5), "ids": F.lit("i"), "item_id": F.lit(None).cast("string")})


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_on_awkward_rows(spark, awkward, name, stage):
    kept = stage(spark, awkward, SF)
    assert kept.columns == awkward.columns and [f.dataType for f in kept.schema] == [f.dataType for f in awkward.schema]
    rows, before = [repr(r) for r in kept.collect()], [repr(r) for r in awkward.collect()]
    if name != "secrets":
        assert set(rows) <= set(before)
    else:
        assert len(rows) == len(before)
    again = stage(spark, awkward.repartition(5), SF)
    assert sorted(map(repr, again.collect())) == sorted(rows)
    assert stage(spark, awkward.limit(0), SF).count() == 0


def test_last_stage_on_awkward_rows(spark, awkward):
    found = corpus_pipeline.pieces(spark, awkward, SF)
    assert found.columns == ["doc_id", "lang", "source", "n_ids", "ids", "round_trip"]
    assert found.count() == awkward.count() and found.where("not round_trip").count() == 0
    assert corpus_pipeline.pieces(spark, awkward.limit(0), SF).count() == 0


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), SF).columns == docs.columns, name

"""A corpus pipeline: quality, near duplicates, benchmark leaks, secrets, pieces.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the
columns of documents; columns beyond those stay as they are, whatever their names. In every stage a null
text counts as an empty one and stays null, repeated rows are treated alike (the near-duplicate stage keeps
one), a null id harms nothing, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orrery.llm.alike import similar_groups
from orrery.llm.decontaminate import drop_contaminated
from orrery.llm.pieces import encode_pieces
from orrery.llm.quality import keep_good, train
from orrery.llm.secrets import redact_secrets
from orrery.llm.simhash import keep_one
from orrery.session import discard, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it is fitted on labelled rows of this stage's input.

    Equal texts share a score, so they stay or go together; an empty text is scored like any other.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_good(docs, model, threshold=0.3)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five words: the one with the least doc_id.

    SimHash fingerprints of five words meet through pigeonhole blocks; pairs as similar that differ in more bits than
    those find come from prefixes of their sets, and every link is computed exactly.
    Ties go by the hashes of the text and of the row; null, empty and blank texts are one group.
    """
    return keep_one(docs, similar_groups(docs, size=5, similarity=0.8))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of eight words of a benchmark item: one leaked item is enough to drop one.

    Null and empty texts have no words and stay.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=8, least_items=1)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and n_chars renewed where one was."""
    return redact_secrets(docs, public_tokenizers.path("byte_bpe_50k.json"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source of every document with its piece ids, how many they are, and that they decode to its text.

    Null and empty texts have no ids.
    """
    found = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), "doc_id", "lang", "source")
    return found.select("doc_id", "lang", "source", "n_ids", "ids", "round_trip")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("pieces", pieces),
]

#: SQL can express neither the classifier nor the novelty and piece stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what no stage reads any more goes."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs

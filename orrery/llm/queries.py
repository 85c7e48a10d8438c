"""The queries of this folder: thin contracts over the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table. One that is read in fewer tasks than there are cores (a small file) is dealt to all of them."""
    found, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return found.repartition(cores) if found.rdd.getNumPartitions() < cores else found


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.pieces import encode_pieces

    found = encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), "doc_id")
    return found.select("doc_id", "n_ids", "ids", "round_trip")


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.token_files import encode_to_files, read_token_files

    folder = encode_to_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.quality import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


#: Records between two whose copy is damaged, in the drill of the audit.
DRILL = 500


def damage(name: str, data: bytes) -> bytes:
    """One bit of every DRILL-th record of a file flipped, from the first on, and of the one after it; half-way between, the bytes at both sides of a boundary.

    Of four files the second loses the last half of its last record, and the third has bytes after it.
    """
    from orrery.llm.warc import members

    changed, number = bytearray(data), int(name.split("-")[0]) % 4
    found = list(members(data))
    for k, (at, n, _) in enumerate(found):
        if k % DRILL < 2:
            changed[at + n // 2] ^= 1
        elif k % DRILL == DRILL // 2 and k + 1 < len(found):
            changed[at + n - 1] ^= 1
            changed[at + n] ^= 1
    if number == 1 and found:
        del changed[found[-1][0] + found[-1][1] // 2 : -1]
    if number == 2 and found:
        changed[-1:] = b"surplus\n"
    return bytes(changed)


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as WARC, copies them with planted damage, and audits the copy."""
    from orrery.llm import warc

    files = warc.files_of(spark, warc.write_warc(table(spark, sf_dir, "pages")))
    return warc.audit(files, warc.copied_files(spark, warc.copy_replica(files, damage)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=8, least_items=2)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.vector_search import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_token_binary": op2_token_binary,
        "op3_simhash": op3_simhash,
        "op4_html_extraction": op4_html_extraction,
        "op5_quality": op5_quality,
        "op6_warc_fixity": op6_warc_fixity,
        "op7_decontamination": op7_decontamination,
        "op8_token_counts": op8_token_counts,
        "op9_secrets": op9_secrets,
        "op10_vector_search": op10_vector_search,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    from orrery.llm.oracles import SQL

    return dict(SQL)

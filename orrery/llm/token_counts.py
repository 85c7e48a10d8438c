"""Token counts with the whole-token shortcut.

Offline (once, on the driver) every vocabulary string is run through the tokeniser alone; those that come
back as one token are proven whole and shipped to the workers. A pre-token that is such a string counts
one, without any merge; only the rest is merged, once for each worker and word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from orrery.llm.byte_bpe import CACHE_WORDS, WordIds, Words, is_marked, split_words
from orrery.llm.common import claim, releasing, ship, slices_by_bytes, texts
from orrery.llm.pieces import Transducer

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
#: Bytes of text that are counted at once, and after which a worker gives free memory back at the end of a task.
AT_ONCE, RELEASE_BYTES = 16 << 20, 40 << 20

_counters: dict[int, Counter] = {}


def tokeniser(data: bytes, pieces: bool) -> WordIds:
    return Transducer(data) if pieces else Words(data)


@functools.cache
def proven(vocabulary: str) -> frozenset[str]:
    """The vocabulary's strings that its tokeniser gives back as the one token that they are; as words of a text,
    with a space where the vocabulary has its mark."""
    words = tokeniser(Path(vocabulary).read_bytes(), vocabulary.endswith(".model"))
    if isinstance(words, Transducer):
        known = list(words.ids_of.items())
        encoded = words._ids([p for p, _ in known])
        return frozenset(p.replace("▁", " ") for (p, k), own in zip(known, encoded, strict=True) if own == [k] and "▁" not in p[1:])
    ids = list(words.tokenizer.get_vocab(with_added_tokens=False).values())
    strings = words.tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False)
    return frozenset(s for i, s, own in zip(ids, strings, words.encode(strings), strict=True) if own == [i])


class Counter:
    """Counts of words: proven whole tokens first, a bounded cache of merged ones next, merges last."""

    def __init__(self, data: bytes, pieces: bool, whole: frozenset[str]):
        self.words = tokeniser(data, pieces)
        self.whole = dict.fromkeys(whole, 1)
        self.merged: dict[str, int] = {}

    @staticmethod
    def of(data: bytes, pieces: bool, whole: frozenset[str]) -> Counter:
        claim("counts", _counters.clear)
        key = hash(data)
        if key not in _counters:
            _counters[key] = Counter(data, pieces, whole)
        return _counters[key]

    def count(self, words: list[str]) -> np.ndarray:
        whole, merged, marked = self.whole.get, self.merged, is_marked if self.words.marks else lambda w: False
        if len(merged) > CACHE_WORDS:
            merged.clear()
        counts = [whole(w) or merged.get(w, -1) for w in words]
        rest = [(k, w, w[:-1] if marked(w) else w) for k, (w, n) in enumerate(zip(words, counts, strict=True)) if n < 0]
        ask = list(dict.fromkeys(base for _, _, base in rest if not whole(base) and base not in merged))
        merged.update(zip(ask, map(len, self.words.encode_words(ask)), strict=True))
        for k, w, base in rest:  # a closing mark after letters is a pre-token of its own
            counts[k] = merged[w] = (whole(base) or merged[base]) + (base is not w)
        return np.array(counts, np.int64)

    def count_column(self, column: pa.Array) -> np.ndarray:
        empty = pc.equal(column, "").to_numpy(zero_copy_only=False)
        plain = self.words.plain(column) & ~empty
        counts = np.zeros(len(column), np.int64)
        easy = column.filter(pa.array(plain))
        if len(easy):
            offsets, keys, words = split_words(easy, self.words.glue_first)
            counts[plain] = np.add.reduceat(self.count(words)[keys], offsets[:-1])
        odd = ~plain & ~empty
        if odd.any():
            counts[odd] = [len(x) for x in self.words.encode(column.filter(pa.array(odd)).to_pylist())]
        return counts


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Bytes and tokens of each text under the vocabulary file at the path ``vocabulary``.

    A .json file is a byte-level one of tokenizers, a .model file one of sentencepiece (counts are of pieces as its
    encode gives them). No begin, end or added special tokens; special strings inside texts are as the library's
    default has them. A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows are
    counted each; an empty table gives an empty one; columns besides the id and the text play no part.
    No shuffle: one pass over the rows.
    """
    spark, pieces = docs.sparkSession, vocabulary.endswith(".model")
    shipped, whole = ship(spark, vocabulary), spark.sparkContext.broadcast(proven(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(shipped.value, pieces, whole.value)
        for batch in batches:
            for at, n in slices_by_bytes(batch.column(1), AT_ONCE):
                part = batch.slice(at, n)
                counts = counter.count_column(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pc.binary_length(part.column(1)).cast(pa.int64()), pa.array(counts), pa.array(counts > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    narrow = texts(docs, doc_id, text=text)
    return narrow.select(narrow[doc_id].cast("bigint").alias("doc_id"), text).mapInArrow(releasing(run, RELEASE_BYTES), SCHEMA)

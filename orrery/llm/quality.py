"""Quality classifier: naive Bayes support vectors over n-grams of words and of their shapes.

Texts are cut at white space; a line feed is a token of its own, and a word of over PIECE characters is as many
tokens as it has pieces of that length, so that every character counts. A token's shape has its runs of
letters by case, its digits as one 0 and its marks as they are, joined with whether the token repeats the
one before. Features are indicators: n-grams of up to three shapes, words (lower case, digits as one 0) and
pairs of words, and how much of the text each shape makes up, in steps. Indicators are scaled by the log
ratio of their smoothed counts in either class (0 for those of a single labelled text); a linear hinge-loss
model over them is fitted by dual coordinate descent, and its margins are mapped to [0, 1] by a logistic
curve fitted on other folds.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import checkpoint, distinct, list_parts, ragged_gather, release, releasing, slices_by_bytes, texts

#: Hashed features, the most labelled rows that a model is fitted on, and the most features of all these together.
BITS = 20
DIMENSIONS = 1 << BITS
MOST_ROWS, MOST_FEATURES = 12_000, 8_000_000
#: Characters of a token, and texts' bytes whose features are made at once.
PIECE, AT_ONCE = 64, 4 << 20
#: Shares of a text from which a shape's share indicators are set.
STEPS = (0.02, 0.1, 0.3, 0.6)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: White space besides spaces and line feeds, in RE2's syntax.
OTHER_SPACE = r"[\t\r\x0b\x0c\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class _Kinds(dict):
    """A character's class, worked out when first met."""

    def __missing__(self, code: int) -> str:
        kind = unicodedata.category(chr(code))
        put = "A" if kind in ("Lu", "Lt") else "a" if kind == "Ll" else "o" if kind[0] in "LM" else "0" if kind == "Nd" else chr(code)
        if len(self) < 1 << 16:
            self[code] = put
        return put


KINDS = _Kinds()


def shapes(words: list[str]) -> list[str]:
    """Runs of small letters as a, of capitals as A (one) or B (more), of other letters as o, of digits as 0; marks
    as they are; a + after words of over 24 characters. Words hold no space."""
    joined = " ".join(words).translate(KINDS)
    for run, put in (("a{2,}", "a"), ("A{2,}", "B"), ("o{2,}", "o"), ("0{2,}", "0")):
        joined = re.sub(run, put, joined)
    return [s + "+" if len(w) > 24 else s for s, w in zip(joined.split(" "), words, strict=True)] if words else []


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 7)


def hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words' shapes and of the words themselves."""
    made = shapes(words)
    of = {s: _hash(s) for s in set(made)}
    folded = re.sub(r"\d+", "0", " ".join(words).lower()).split(" ") if words else []
    return np.array([of[s] for s in made], np.uint64), np.array([_hash(w) for w in folded], np.uint64)


def mix(*parts: np.ndarray | int) -> np.ndarray:
    h = np.uint64(0)
    for p in parts:
        h = (h ^ np.asarray(p, np.uint64)) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, distinct and sorted, of a column of texts."""
    if pc.any(pc.match_substring_regex(column, OTHER_SPACE)).as_py():
        column = pc.replace_substring_regex(column, OTHER_SPACE, " ")
    lines = pc.replace_substring(column, "\n", " \n ")
    offsets, values = list_parts(pc.split_pattern(lines, " "))
    coded = values.dictionary_encode()
    del lines, values
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.to_pylist()
    rows = np.repeat(np.arange(len(column)), np.diff(offsets))
    if max(map(len, words), default=0) > PIECE:  # long words are read piece by piece
        cut = [[w[k : k + PIECE] for k in range(0, len(w), PIECE)] or [""] for w in words]
        many = np.fromiter(map(len, cut), np.int64, len(cut))
        words, start = [p for x in cut for p in x], np.cumsum(many) - many
        rows = np.repeat(rows, many[codes])
        codes = ragged_gather(np.arange(len(words)), start[codes], many[codes])
    sizes = np.bincount(rows, minlength=len(column))
    shape, word = (h[codes] for h in hashes(words))
    repeat = np.zeros(len(codes), bool)
    repeat[1:] = (codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1])
    pairs = lambda r, h: (r.astype(np.uint64) << np.uint64(BITS)) | (h & np.uint64(DIMENSIONS - 1))
    keyed = []
    with np.errstate(over="ignore"):
        shape = np.where(repeat, mix(shape, 1), shape)
        for tokens, most, salt in ((shape, 3, 11), (word, 2, 71)):
            for n in range(1, most + 1):
                inside = rows[n - 1 :] == rows[: len(rows) - n + 1]
                gram = mix(*(tokens[i : len(tokens) - n + 1 + i] for i in range(n)), salt * n)
                keyed.append(distinct(pairs(rows[n - 1 :][inside], gram[inside])))
        single = np.sort(pairs(rows, mix(shape, 5)))
        ends = np.flatnonzero(np.concatenate([single[1:] != single[:-1], np.ones(min(1, len(single)), bool)]))
        single, counts = single[ends], np.diff(ends, prepend=-1)
        own = (single >> np.uint64(BITS)).astype(np.int64)
        share = counts / sizes[own]
        keyed += [pairs(own[share >= s], mix(single[share >= s] & np.uint64(DIMENSIONS - 1), 17 + k)) for k, s in enumerate(STEPS)]
    both = distinct(np.concatenate(keyed))
    return (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64(DIMENSIONS - 1)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, column: pa.Array) -> np.ndarray:
        rows, cols = features(column)
        return np.bincount(rows, self.weights[cols], len(column)) / scale_of(rows, len(column)) + self.bias

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(column) + self.offset, -500, 500)))


def scale_of(rows: np.ndarray, n: int) -> np.ndarray:
    """Texts of any length weigh alike: indicators are divided by the root of their number."""
    return np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))


def log_count_ratio(indptr: np.ndarray, cols: np.ndarray, y: np.ndarray, smooth: float = 1.0, least: int = 2) -> np.ndarray:
    """Of each feature; 0 for those of fewer than ``least`` texts, which tell texts apart rather than classes."""
    up, down = (np.bincount(cols[np.repeat(y == k, np.diff(indptr))], minlength=DIMENSIONS) + smooth for k in (1, -1))
    return np.where(up + down >= least + 2 * smooth, np.log(up / up.sum()) - np.log(down / down.sum()), 0.0)


def dual_coordinate_descent(indptr, cols, values, y, cost: float = 1.0, rounds: int = 20, seed: int = 5, tolerance: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model; the bias is the weight of a constant feature.

    Rounds end when no coordinate's gradient, as far as its bounds let it move, exceeds the tolerance.
    """
    w, bias, alpha = np.zeros(DIMENSIONS), 0.0, np.zeros(len(y))
    square = np.array([values[a:b] @ values[a:b] for a, b in zip(indptr[:-1], indptr[1:], strict=True)]) + 1
    # The rarer class costs more, so that both weigh alike.
    n = np.bincount((y > 0).astype(int), minlength=2)
    most = cost * np.where(y > 0, len(y) / max(2 * n[1], 1), len(y) / max(2 * n[0], 1))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(y)).tolist():
            a, b = indptr[i], indptr[i + 1]
            c, v = cols[a:b], values[a:b]
            gradient = y[i] * (w[c] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), most[i])
            worst = max(worst, abs(new - alpha[i]) * square[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[c] += step * v
                bias += step
                alpha[i] = new
        if worst < tolerance:
            break
    return w, bias


def fit_rows(indptr, cols, y) -> tuple[np.ndarray, float]:
    ratio = log_count_ratio(indptr, cols, y)
    size = np.sqrt(np.maximum(np.diff(indptr), 1)).astype(np.float32)
    w, bias = dual_coordinate_descent(indptr, cols, ratio.astype(np.float32)[cols] / np.repeat(size, np.diff(indptr)), y)
    return w * ratio, bias


def logistic(margins: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of P(y = 1) by Newton's method, with Platt's smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        g, h = target - p, np.maximum(p * (1 - p), 1e-9)
        matrix = np.array([[(h * margins**2).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(matrix, [(g * margins).sum(), g.sum()])
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-6), b


def sparse(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The features of all texts one after the other, and where each text's begin and end."""
    rows, cols = features(column)
    return np.searchsorted(rows, np.arange(len(column) + 1)), cols


def fit(indptr: np.ndarray, cols: np.ndarray, labels: np.ndarray, folds: int = 3) -> Model:
    """A model from features and 0/1 labels. With one class only, or none, every score is the smoothed rate."""
    y = np.where(labels > 0, 1, -1)
    rate = ((y > 0).sum() + 1) / (len(y) + 2)
    if len(y) < 2 * folds or abs(y.sum()) == len(y):
        return Model(np.zeros(DIMENSIONS), 0.0, 1.0, float(np.log(rate / (1 - rate))))
    fold, margins = np.arange(len(y)) % folds, np.zeros(len(y))

    def part(mask: np.ndarray):
        at = np.flatnonzero(mask)
        pick = [cols[indptr[i] : indptr[i + 1]] for i in at.tolist()]
        return np.concatenate([[0], np.cumsum([len(p) for p in pick])]).astype(int), np.concatenate(pick), y[at]

    for k in range(folds):
        w, bias = fit_rows(*part(fold != k))
        for i in np.flatnonzero(fold == k).tolist():
            own = cols[indptr[i] : indptr[i + 1]]
            margins[i] = w[own].sum() / np.sqrt(max(len(own), 1)) + bias
    return Model(*fit_rows(indptr, cols, y), *logistic(margins, y))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS, most_features: int = MOST_FEATURES, doc_id: str = "doc_id", text: str = "text"
) -> Model:
    """Fit on labelled rows that aren't held out: on at most about ``most_rows``, with about ``most_features`` features together.

    Where there are more, rows are chosen by a hash. Rows with a null id or label are left out; of labels that
    disagree on an id, each counts, as does each text of an id; repeated rows count once. Null texts are empty
    ones. Without labelled rows, or with one class alone, every score is the smoothed rate.
    """
    usable = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).where(~held_out(F.col("doc_id"))).dropna().distinct()

    def some(df: DataFrame, n: int, most: int, *key: str) -> DataFrame:
        return df if n <= most else df.where(F.pmod(F.xxhash64(*key, F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * most / n))

    usable = some(usable, usable.count(), most_rows, "doc_id")
    narrow = texts(docs, doc_id, text=text).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices_by_bytes(batch.column(3), AT_ONCE):
                part = batch.slice(at, n)
                indptr, cols = sparse(part.column(3))
                lists = pa.ListArray.from_arrays(pa.array(indptr, pa.int32()), pa.array(cols, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], lists], names=["doc_id", "y", "h", "cols"])

    # The labels kept are at most about most_rows, whatever the table: small enough to broadcast.
    joined = narrow.join(F.broadcast(usable), "doc_id").select("doc_id", "y", F.xxhash64("text").alias("h"), "text")
    made = joined.mapInArrow(releasing(run), "doc_id bigint, y int, h bigint, cols array<int>")
    learnt = checkpoint(made.groupBy("doc_id", "y", "h").agg(F.first("cols").alias("cols")))
    n, total = learnt.agg(F.count("*"), F.coalesce(F.sum(F.size("cols")), F.lit(0))).first()
    kept = some(some(learnt, n, most_rows, "doc_id", "h"), total, most_features, "h", "doc_id")
    table = kept.toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending"), ("h", "ascending")]).combine_chunks()
    release()
    cols = table["cols"].combine_chunks() if len(table) else pa.array([], pa.list_(pa.int32()))
    offsets, flat = list_parts(cols)
    return fit(offsets, flat.to_numpy(), table["y"].to_numpy())


def score(docs: DataFrame, model: Model, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row; a null text is scored as an empty one.

    The score depends on the text alone, so equal texts score alike; a null id isn't held out. Repeated rows come
    out each; other columns, whatever their names, play no part; an empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices_by_bytes(batch.column(1), AT_ONCE):
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shipped.value.scores(part.column(1)))], names=["doc_id", "score"])

    narrow = texts(docs, doc_id, text=text).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    scored = narrow.mapInArrow(releasing(run), "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows whose text scores at least ``threshold``, with all their columns, whatever their names and types.

    A null text is scored as an empty one and stays null; equal texts are kept or dropped together; repeated
    rows stay each; an empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column(schema.names.index(text)).cast(pa.string()), "")
            for at, n in slices_by_bytes(column, AT_ONCE):
                yield batch.slice(at, n).filter(pa.array(shipped.value.scores(column.slice(at, n)) >= threshold))

    return docs.mapInArrow(releasing(run), schema)

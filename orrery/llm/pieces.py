"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three transducers are compiled from a model file. The normaliser reads characters and writes what the model
has for them (its rules, the space mark, a mark before the text); its two states tell whether a space was
written last. The pieces' transducer writes ids. The byte fallback reads one character without a piece and
writes its bytes' ids, or the unknown id. Composed with an input they give a lattice over its positions,
and relaxation in the tropical semiring (least sum of weights) from left to right gives the shortest path.

In a unigram model the pieces' transducer has one state and an arc's weight is less the piece's score. In
a merge (BPE) model its states are the pieces: a sequence is the encoding exactly if each piece and
each pair of neighbours is what the merges make of them alone, so an arc from one piece to the next weighs
0 if the merges leave the pair as it is, and is infinite otherwise. Weights are worked out when first met.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.byte_bpe import WordIds
from orrery.llm.common import claim, ragged_gather, releasing, ship, slices_by_bytes, texts

MARK = "▁"
#: Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
#: Fixed value: what a character without a piece costs beyond the least score of a piece.
UNKNOWN_COST = 10.0
#: Arcs whose weights a worker keeps; beyond, it starts anew.
CACHE_ARCS = 400_000
#: Texts that aren't cut at single spaces: their runs of marks are cut one by one.
ODD = r"  |\n\n| \n|\n |^[ \n]|[ \n]$|\x{2581}"
INFINITE = float("inf")
#: Bytes of text that are encoded at once.
ENCODE_BYTES = 2 << 20


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = number() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


def rules_of(charsmap: bytes) -> dict[str, str]:
    """The arcs of a compiled character map: a double-array trie over UTF-8, then the outputs."""
    if not charsmap:
        return {}
    (size,) = struct.unpack_from("<I", charsmap)
    units, outputs = np.frombuffer(charsmap, "<u4", size // 4, 4).astype(np.int64), charsmap[4 + size :]
    offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
    found: dict[str, str] = {}
    labels = np.arange(1, 256)
    held = [(int(offset(units[0])), b"")]
    while held:
        base, key = held.pop()
        places = base ^ labels
        inside = places < len(units)
        children = places[inside][(units[places[inside]] & 0x800000FF) == labels[inside]]
        for place in children.tolist():
            unit, own = int(units[place]), key + bytes([place ^ base])
            below = place ^ offset(unit)
            if unit >> 8 & 1:
                at = int(units[below]) & 0x7FFFFFFF
                found[own.decode()] = outputs[at : outputs.index(b"\0", at)].decode()
            held.append((below, own))
    return found


class Normaliser:
    """The first transducer: of all arcs at a position the longest is taken, and without one a character stays."""

    def __init__(self, spec: dict):
        self.rules = rules_of(spec.get(2, b""))
        self.prefix, self.single = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.mark = MARK if spec.get(5, 1) else " "
        self.longest, self.first = max(map(len, self.rules), default=0), {r[0] for r in self.rules}
        #: Whether words can be read by themselves: each character is, and no space is dropped.
        self.local = not self.rules and not self.single
        self.table = {ord(" "): self.mark}

    def _arcs(self, text: str) -> Iterator[str]:
        if not self.rules or self.first.isdisjoint(text):
            yield from text
            return
        at = 0
        while at < len(text):
            take, put = 1, text[at]
            for n in range(min(self.longest, len(text) - at) if put in self.first else 0, 0, -1):
                if (found := self.rules.get(text[at : at + n])) is not None:
                    take, put = n, found
                    break
            yield put
            at += take

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        if self.local:
            return (self.mark if self.prefix else "") + text.translate(self.table)
        out, spaced = [], self.single
        for put in self._arcs(text):
            put = put.lstrip(" ") if spaced else put
            if put:
                out.append(put)
                spaced = self.single and put[-1] == " "
        whole = (self.mark if self.prefix else "") + "".join(out).translate(self.table)
        return whole.rstrip(self.mark) if self.single else whole


class Transducer(WordIds):
    """The three transducers of a model, with the ids of words it has met."""

    odd = ODD
    glue_first = False
    most_words = 340_000

    def __init__(self, data: bytes):
        super().__init__()
        self.pieces: list[str] = []
        self.ids_of: dict[str, int] = {}
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.normal, trainer = Normaliser({}), {}
        for key, value in fields(data):
            if key == 1:
                self._piece(dict(fields(value)))
            elif key == 2:
                trainer = dict(fields(value))
            elif key == 3:
                self.normal = Normaliser(dict(fields(value)))
        self.model = trainer.get(3, UNIGRAM)
        if self.model not in (UNIGRAM, MERGES) or trainer.get(24, 0):
            raise ValueError("only unigram and merge (BPE) models with spaces before words are compiled")
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)] if BYTE in self.kinds else []
        self.score = {p: self.scores[k] for p, k in self.ids_of.items()}
        self.longest = max(map(len, self.score))
        self.unknown_score = np.float32(min(self.score.values())) - np.float32(UNKNOWN_COST)
        #: The state outside all pieces: at the beginning, and after a character without a piece.
        self.outside = len(self.pieces)
        self.weights: dict[int, float] = {}
        # Where no piece crosses from another character to a mark or a line feed, those cut the input.
        self.cuts = self.model == MERGES and not any("\n" in p and p != "\n" or MARK in p.lstrip(MARK) for p in self.score)
        # The order of merges of one score depends on more than neighbours: such words are single arcs.
        often = Counter(self.score.values())
        tied = [p for p, x in self.score.items() if often[x] > 1]
        self.tied = any(p.strip(MARK) for p in tied)
        if not (self.cuts and self.normal.local and self.bytes):
            self.odd = ""  # every text is read as a whole: runs of unknown characters cross words
        self.glue_first = not self.normal.prefix
        # Decoding: the bytes that each id writes.
        self.output = [b""] * len(self.pieces)
        for k, (p, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if kind == BYTE:
                self.output[k] = bytes([int(p[3:5], 16)])
            elif kind == UNKNOWN:
                self.output[k] = trainer.get(44, " ⁇ ".encode())
            elif kind != CONTROL:
                self.output[k] = p.replace(MARK, " ").encode()
        self.output_bytes = np.frombuffer(b"".join(self.output), np.uint8)
        self.output_length = np.fromiter(map(len, self.output), np.int64, len(self.output))
        self.output_start = np.cumsum(self.output_length) - self.output_length

    _workers: dict[int, Transducer] = {}

    @classmethod
    def of(cls, data: bytes) -> Transducer:
        """One for each worker process and model."""
        claim("pieces", cls._workers.clear)
        key = hash(data)
        if key not in cls._workers:
            cls._workers[key] = cls(data)
        return cls._workers[key]

    def _piece(self, piece: dict) -> None:
        text, kind, k = piece[1].decode(), piece.get(3, NORMAL), len(self.pieces)
        self.pieces.append(text)
        self.kinds.append(kind)
        self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
        if kind == NORMAL:
            self.ids_of[text] = k
        elif kind in (USER, UNUSED):
            raise ValueError("user-defined and unused pieces aren't compiled")

    def merges(self, text: str) -> list[str]:
        """What the model's merges make of a string: the best pair first, of equal ones the leftmost."""
        parts, score = list(text), self.score
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(-score[p], k, p) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in score]
        heapq.heapify(heap)
        while heap:
            _, k, p = heapq.heappop(heap)
            n = after[k]
            if not parts[k] or n >= len(parts) or parts[k] + parts[n] != p or not parts[n]:
                continue
            parts[k], parts[n] = p, ""
            after[k] = n = after[n]
            if n < len(parts):
                before[n] = k
                if (q := p + parts[n]) in score:
                    heapq.heappush(heap, (-score[q], k, q))
            b = before[k]
            if b >= 0 and (q := parts[b] + p) in score:
                heapq.heappush(heap, (-score[q], b, q))
        return [p for p in parts if p]

    def fallback(self, character: str) -> list[int]:
        """What the third transducer writes for a character without a piece."""
        return [self.bytes[b] for b in character.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def weight(self, left: int, right: int) -> float:
        """Of the arc of a merge model from the state of one piece, or outside, to that of the next."""
        if len(self.weights) > CACHE_ARCS:
            self.weights.clear()
        a, b = "" if left == self.outside else self.pieces[left], self.pieces[right]
        w = 0.0 if self.merges(a + b) == ([a, b] if a else [b]) else INFINITE
        self.weights[left * (self.outside + 1) + right] = w
        return w

    def merge_paths(self, texts: list[str]) -> Iterator[list[int]]:
        """The shortest path of the composition with each normalised text of a merge model, as ids.

        Texts that share a prefix with the one before share that part of the lattice.
        """
        ids_of, weights, longest, outside = self.ids_of.get, self.weights, self.longest, self.outside
        width = outside + 1
        before, state, begin = "", [outside], [0]
        for text in texts:
            n, same = len(text), 0
            for a, b in zip(text, before, strict=False):
                if a != b:
                    break
                same += 1
            del state[same + 1 :], begin[same + 1 :]
            for end in range(same + 1, n + 1):
                # Every position has one state with a finite path, so its distance is 0 and an arc's weight is the path's.
                least, start_of, state_of = INFINITE, end - 1, outside
                for start in range(end - 1, max(-1, end - longest - 1), -1):
                    k = ids_of(text[start:end])
                    if k is None:
                        if end - start > 1:
                            continue
                        k, w = outside, 0.0
                    else:
                        w = weights.get(state[start] * width + k)
                        if w is None:
                            w = self.weight(state[start], k)
                    if w < least:
                        least, start_of, state_of = w, start, k
                        if not w:
                            break  # the semiring's one: nothing is less
                begin.append(start_of)
                state.append(state_of)
            before, out = text, []
            while n:
                out.append([state[n]] if state[n] != outside else self.fallback(text[begin[n] : n])[::-1])
                n = begin[n]
            yield self._joined(i for x in out for i in x)

    def _joined(self, backward: Iterator[int]) -> list[int]:
        """Ids in order, given from the end; a run of unknown characters is one unknown id."""
        ids = list(backward)[::-1]
        if self.bytes:
            return ids
        return [i for k, i in enumerate(ids) if i != self.unknown or not k or ids[k - 1] != self.unknown]

    def unigram_path(self, text: str) -> list[int]:
        """The shortest path of a unigram model, in single precision as the library adds; of equal ones the first met."""
        n, ids_of, scores, longest = len(text), self.ids_of.get, [np.float32(x) for x in self.scores], self.longest
        distance = [np.float32(0)] + [np.float32(INFINITE)] * n
        begin, arc = [0] * (n + 1), [self.outside] * (n + 1)
        for start in range(n):
            here, alone = distance[start], False
            for end in range(start + 1, min(n, start + longest) + 1):
                k = ids_of(text[start:end])
                if k is not None:
                    alone |= end == start + 1
                    if (d := here - scores[k]) < distance[end]:
                        distance[end], begin[end], arc[end] = d, start, k
            if not alone and (d := here - self.unknown_score) < distance[start + 1]:
                distance[start + 1], begin[start + 1], arc[start + 1] = d, start, self.outside
        out = []
        while n:
            out.append([arc[n]] if arc[n] != self.outside else self.fallback(text[begin[n] : n])[::-1])
            n = begin[n]
        return self._joined(i for x in out for i in x)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of normalised texts."""
        if self.model == UNIGRAM:
            return [self.unigram_path(t) for t in texts]
        out = []
        for text, path in zip(texts, self.merge_paths(texts), strict=True):
            if self.tied or len(text) > 1 and text[-1] == MARK and text.count(MARK) == len(text):
                # Merges of one score: the word is an arc of its own, from outside to outside.
                parts = ([k] if (k := self.ids_of.get(p)) is not None else self.fallback(p) for p in self.merges(text))
                path = self._joined(reversed([i for x in parts for i in x]))
            out.append(path)
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        order = sorted(range(len(words)), key=words.__getitem__)
        out: list[list[int]] = [[]] * len(words)
        for k, ids in zip(order, self._ids([words[k].translate(self.normal.table) for k in order]), strict=True):
            out[k] = ids
        return out

    def encode(self, strings: list[str]) -> list[list[int]]:
        if not self.cuts:
            return self._ids([self.normal(s) for s in strings])
        cut = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
        out = []
        for s in strings:
            words = cut.findall(self.normal(s))
            own = sorted(set(words))
            ids = dict(zip(own, self._ids(own), strict=True))
            found = [i for w in words for i in ids[w]]
            out.append(found if self.bytes else self._joined(reversed(found)))
        return out

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        empty = pc.equal(column, "").to_numpy(zero_copy_only=False)
        if not empty.any():
            return super().encode_column(column)
        counts = np.zeros(len(column), np.int64)
        ids, counts[~empty] = super().encode_column(column.filter(pa.array(~empty)))
        return ids, counts

    def decode(self, ids: list[int]) -> str:
        """The text of ids: a mark at the beginning is the normaliser's; where it keeps single spaces, so are all there."""
        out, trim = [], self.normal.prefix or self.normal.single
        for i in ids:
            put = self.output[i]
            if self.kinds[i] == CONTROL:
                continue
            if trim and self.kinds[i] == NORMAL and put[:1] == b" ":
                put, trim = put[1:], self.normal.single and len(put) == 1
            else:
                trim = False
            out.append(put)
        return b"".join(out).decode("utf-8", "replace")

    def decode_column(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of runs of ids, as ``decode`` gives them."""
        lengths = self.output_length[ids]
        data = ragged_gather(self.output_bytes, self.output_start[ids], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        found = pa.StringArray.from_buffers(len(counts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
        try:
            found.validate(full=True)
            plain = not self.normal.single and not (ids == self.unknown).any()
        except pa.ArrowInvalid:  # ids that don't come from a text
            plain = False
        if not plain:
            edges = np.concatenate([[0], np.cumsum(counts)]).tolist()
            return pa.array([self.decode(ids[a:b].tolist()) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.string())
        return pc.replace_substring_regex(found, r"\A ", "") if self.normal.prefix else found


def encode_pieces(docs: DataFrame, model: str, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep``, ids and n_ids of every text, decoded (what the ids decode to), round_trip.

    A null or empty text has no ids. round_trip is whether the decoded text is the text; a literal space
    mark (U+2581) in a text decodes as a space, and doesn't count against it; a model whose normaliser changes
    texts gives false there. Rows come out each, repeated ones too; null ids stay null; other columns play no
    part; an empty table gives no rows. No shuffle. ``keep`` may not hold the names of the new columns.
    """
    shipped = ship(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = Transducer.of(shipped.value)
        for batch in batches:
            for at, n in slices_by_bytes(batch.column(batch.num_columns - 1), ENCODE_BYTES):
                part = batch.slice(at, n)
                column = part.column(part.num_columns - 1)
                ids, counts = transducer.encode_column(column)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int32)))
                decoded = transducer.decode_column(ids, counts)
                same = pc.equal(decoded, pc.replace_substring(column, MARK, " "))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array(counts), decoded, same], names=[*part.schema.names[:-1], "ids", "n_ids", "decoded", "round_trip"])

    narrow = texts(docs, *keep, text=text)
    head = [f"`{n}` {narrow.schema[n].dataType.simpleString()}" for n in keep]
    return narrow.mapInArrow(releasing(run), ", ".join([*head, "ids array<int>", "n_ids bigint", "decoded string", "round_trip boolean"]))

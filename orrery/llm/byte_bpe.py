"""Byte-level BPE over Arrow columns: words are told apart once a batch, and merged once a worker.

The pre-tokeniser of a byte-level BPE cuts before a single space that a non-space follows and on both
sides of a lone line feed. So a text without longer runs of white space is a sequence of words, each
with or without its leading space, whose ids do not depend on their neighbours. ``PLAIN`` tells such
texts; all others are encoded whole by the library.
"""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from orrery.llm.common import claim, list_parts, ragged_gather

#: White space other than single inner spaces and single inner line feeds, in RE2's syntax.
ODD_SPACE = (
    r"  |\n\n| \n|\n |^[ \n]|[ \n]$|[\t\r\x0b\x0c\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
#: Words a worker keeps; beyond, it keeps those that the texts at hand have.
#: Just below where Python doubles the table of a dict.
CACHE_WORDS = 690_000

_workers: dict[int, Words] = {}


class WordIds:
    """A bounded cache of the ids of words, in arrays that whole columns are gathered from."""

    #: Closing marks that always stand alone after letters.
    marks: tuple[str, ...] = ()
    #: RE2's pattern of texts that can't be cut into words by ``split_words``.
    odd = ""
    #: Whether a text's first word has no space before it.
    glue_first = True
    #: Words kept.
    most_words = CACHE_WORDS

    def __init__(self) -> None:
        self.clear()

    def encode(self, strings: list[str]) -> list[list[int]]:
        """Ids of whole texts."""
        raise NotImplementedError

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words."""
        raise NotImplementedError

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.start = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int32)
        self.ids = np.zeros(4096, np.uint32)
        self.used = 0

    def _add(self, words: list[str], lengths: np.ndarray, flat: np.ndarray) -> None:
        n = len(self.slot)
        while len(self.start) < n + len(words):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.start[n : n + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + len(words)] = lengths
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.slot.update(zip(words, range(n, n + len(words)), strict=True))

    def _keep(self, words: list[str], found: np.ndarray) -> None:
        """Forget all words but those that were found now, and set their new places."""
        known = np.flatnonzero(found >= 0)
        places = found[known]
        lengths = self.length[places].astype(np.int64)
        ids = ragged_gather(self.ids, self.start[places], lengths)
        self.clear()
        self._add([words[k] for k in known.tolist()], lengths, ids)
        found[known] = np.arange(len(known))

    def slots(self, words: list[str]) -> np.ndarray:
        """Places of the words in the cache; those that are new are encoded. A word of letters and one
        closing mark is its letters' ids and then the mark's: the pre-tokeniser cuts between them."""
        found = np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if not len(missing):
            return found
        if len(self.slot) and len(self.slot) + len(missing) > self.most_words:
            self._keep(words, found)
        new = [words[k] for k in missing.tolist()]
        marks, marked, others = self.marks, [], []
        for w in new:
            (marked if w[-1:] in marks and is_marked(w) else others).append(w)
        base = [w[:-1] for w in marked]
        whole = [w for w in dict.fromkeys([*marks, *others, *base]) if w not in self.slot]
        ids = self.encode_words(whole)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self._add(whole, lengths, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())))
        two = np.empty((len(marked), 2), np.int64)
        two[:, 0] = np.fromiter(map(self.slot.__getitem__, base), np.int64, len(base))
        two[:, 1] = [self.slot[w[-1]] for w in marked]
        lengths = self.length[two].astype(np.int64)
        self._add(marked, lengths.sum(1), ragged_gather(self.ids, self.start[two].ravel(), lengths.ravel()))
        found[missing] = np.fromiter(map(self.slot.__getitem__, new), np.int64, len(new))
        return found

    def plain(self, column: pa.Array) -> np.ndarray:
        if not self.odd:
            return np.zeros(len(column), bool)
        return ~pc.match_substring_regex(column, self.odd).to_numpy(zero_copy_only=False)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        plain = self.plain(column)
        if plain.all():
            return self._encode_plain(column)
        counts = np.zeros(len(column), np.int64)
        easy, n_easy = self._encode_plain(column.filter(pa.array(plain)))
        hard = self.encode(column.filter(pa.array(~plain)).to_pylist())
        n_hard = np.fromiter(map(len, hard), np.int64, len(hard))
        counts[plain], counts[~plain] = n_easy, n_hard
        flat = np.concatenate([easy, np.fromiter((i for x in hard for i in x), np.uint32, int(n_hard.sum()))])
        starts = np.zeros(len(column), np.int64)
        starts[plain] = np.cumsum(n_easy) - n_easy
        starts[~plain] = len(easy) + np.cumsum(n_hard) - n_hard
        return ragged_gather(flat, starts, counts), counts

    def _encode_plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(column) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        offsets, keys, words = split_words(column, self.glue_first)
        slots = self.slots(words)
        lengths = self.length[slots][keys].astype(np.int64)
        ids = ragged_gather(self.ids, self.start[slots][keys], lengths)
        return ids, np.add.reduceat(lengths, offsets[:-1])


class Words(WordIds):
    """A byte-level tokeniser of the tokenizers library."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_buffer(data)
        self.marks = MARKS
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([ODD_SPACE, *(pc_quote(t) for t in added)])

    @staticmethod
    def of(data: bytes) -> Words:
        """One for each worker process and vocabulary."""
        claim("words", _workers.clear)
        key = hash(data)
        if key not in _workers:
            _workers[key] = Words(data)
        return _workers[key]

    def encode(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words. Letters with or without one space before are one pre-token, so they go to the
        library's merges directly, written in the byte alphabet; the rest takes the whole path."""
        merge, letters, rest = self.tokenizer.model.tokenize, [], []
        for k, w in enumerate(words):
            (letters if (w[1:] if w[:1] == " " else w).isalpha() else rest).append(k)
        ids: list[list[int]] = [[]] * len(words)
        for k in letters:
            w = words[k]
            ids[k] = [t.id for t in merge(w.replace(" ", SPACE) if w.isascii() else w.encode().decode("latin1").translate(ALPHABET))]
        for k, own in zip(rest, self.encode([words[k] for k in rest]), strict=True):
            ids[k] = own
        return ids


def split_words(column: pa.Array, glue_first: bool) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For plain texts: offsets by text, the key of each word, and the word of each key that occurs."""
    spaced = pc.replace_substring(column, "\n", " \n ")
    offsets, values = list_parts(pc.split_pattern(spaced, " "))
    coded = values.dictionary_encode()
    del spaced, values
    codes, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    feed = words.index("\n") if "\n" in words else -1
    glued = codes == feed
    glued[1:] |= glued[:-1].copy()
    glued[offsets[:-1]] = glue_first
    keys = codes + glued * len(words)
    occurs = np.flatnonzero(np.bincount(keys, minlength=2 * len(words)))
    dense = np.zeros(2 * len(words), np.int64)
    dense[occurs] = np.arange(len(occurs))
    n = len(words)
    return offsets, dense[keys], [words[k - n] if k >= n else " " + words[k] for k in occurs.tolist()]


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: bytes that print in Latin-1 stand for themselves, the others for the
    characters from 256 on, in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


ALPHABET = byte_alphabet()
SPACE = ALPHABET[ord(" ")]
#: Closing marks that stand alone after letters.
MARKS = (".", ",")


def is_marked(word: str) -> bool:
    """Letters, with or without one space before, and one closing mark."""
    return word[-1:] in MARKS and (word[1:-1] if word[:1] == " " else word[:-1]).isalpha()


def pc_quote(text: str) -> str:
    """A literal in RE2's syntax."""
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)

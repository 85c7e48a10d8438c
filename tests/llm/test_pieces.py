"""Encoding and decoding against the library: merge and unigram models, normalisers, byte fallback."""

import random
import struct

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from orrery.llm import pieces

MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()


def number(x):
    out = b""
    while x > 127:
        out, x = out + bytes([x & 127 | 128]), x >> 7
    return out + bytes([x])


def field(key, value):
    if isinstance(value, float):
        return number(key << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return number(key << 3) + number(value)
    value = value.encode() if isinstance(value, str) else value
    return number(key << 3 | 2) + number(len(value)) + value


def model(kind, scored, normaliser, with_bytes):
    """A small model written by hand: special pieces, bytes, scored pieces."""
    special = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256 * with_bytes)]
    listed = [*special, *((p, s, 1) for p, s in scored)]
    body = b"".join(field(1, field(1, p) + field(2, s) + field(3, k)) for p, s, k in listed)
    trainer = field(3, kind) + field(35, int(with_bytes)) + field(40, 0) + field(41, 1) + field(42, 2) + field(43, 2**64 - 1)
    return body + field(2, trainer) + field(3, normaliser)


def identity(prefix=1, single=0):
    return field(1, "identity") + field(2, b"") + field(3, prefix) + field(4, single) + field(5, 1)


def nmt_nfkc():
    made = dict(pieces.fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))
    return field(1, "nmt_nfkc") + field(2, dict(pieces.fields(made[3]))[2]) + field(3, 1) + field(4, 1) + field(5, 1)


NORMALISERS = {"identity": identity(), "no prefix": identity(prefix=0), "single spaces": identity(single=1), "nmt_nfkc": nmt_nfkc()}
SCORED = [("▁", -2.0), ("a", -3.0), ("b", -3.25), ("ab", -4.0), ("aba", -5.5), ("▁a", -3.5), ("▁ab", -4.75), ("ba", -5.0), ("bab", -7.0), ("c", -6.0), ("▁▁", -3.0), ("fi", -8.0), ("é", -9.0), ("abab", -9.0)]
MERGED = [(p, -float(k)) for k, p in enumerate(["ab", "▁a", "aba", "▁ab", "abab", "fi", "▁", "a", "b", "c", "f", "i", "é"])]


def strings(seed, alphabet, n=400, most=40):
    dice = random.Random(seed)
    return ["", " ", "  ", "a", " a", "a "] + ["".join(dice.choices(alphabet, k=dice.randint(1, most))) for _ in range(n)]


def check(data, texts):
    library, own = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Transducer(data)
    ids, counts = own.encode_column(pa.array(texts))
    want = [library.encode(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
    assert own.decode_column(ids, counts).to_pylist() == [library.decode(w) for w in want]
    assert [own.normal(t) for t in texts] == [library.normalize(t) for t in texts]


@pytest.mark.parametrize("with_bytes", [False, True])
@pytest.mark.parametrize("normaliser", NORMALISERS)
@pytest.mark.parametrize("kind", [pieces.UNIGRAM, pieces.MERGES])
def test_small_models(kind, normaliser, with_bytes):
    data = model(kind, SCORED if kind == pieces.UNIGRAM else MERGED, NORMALISERS[normaliser], with_bytes)
    check(data, strings(1, "aaabbbcxé ▁ﬁＡ　 \n"))


def test_runs_of_marks():
    dice = random.Random(3)
    check(MODEL, [" " * dice.randint(0, 70) + dice.choice(["abc", "", "the end", "é"]) + " " * dice.randint(0, 40) + dice.choice(["x", "", "\n"]) for _ in range(400)])


def test_merge_model_on_random_unicode():
    check(MODEL, strings(5, "abcdefghij  \n\t▁é.=日本語-0129😀ﬁ", n=1500, most=60))


def test_path_is_the_least_of_all():
    """Every path of small unigram lattices, one by one."""
    own = pieces.Transducer(model(pieces.UNIGRAM, SCORED, identity(prefix=0), True))

    def all_paths(text):
        if not text:
            yield 0.0, ()
        for n in range(1, len(text) + 1):
            if text[:n] in own.ids_of:
                for cost, rest in all_paths(text[n:]):
                    yield cost - own.score[text[:n]], (own.ids_of[text[:n]], *rest)

    for text in ("abab", "ababa▁ab", "▁▁abba", "bababab"):
        costs = sorted(all_paths(text))
        path = own.unigram_path(text)
        assert -sum(own.scores[k] for k in path) == pytest.approx(costs[0][0])


def test_models_that_are_not_compiled():
    with pytest.raises(ValueError):
        pieces.Transducer(model(3, SCORED, identity(), False))
    with pytest.raises(ValueError):
        pieces.Transducer(field(1, field(1, "x") + field(3, 4)))

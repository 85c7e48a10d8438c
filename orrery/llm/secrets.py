"""Secret scans: fixed patterns, and strings that a dictionary-primed zstandard can't compress.

A candidate is a long run of key characters at most WITHIN characters after a sensitive word, on its line or at
the beginning of the next one, or the body of a private key block. Its novelty is its marginal bytes: what
it adds to the compressed size of the text around it (AROUND characters on either side), for each of its
characters. The dictionary is trained on identifiers and code made of a public vocabulary's words, so words
cost little, however they are joined; key material costs the most that there is. A few bytes more or less
depend on how the compressor codes the text before, so the mean is taken over some openings of code.
"""

from __future__ import annotations

import functools
import hashlib
import json
import random
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from orrery.llm.common import claim, releasing, texts

#: The base patterns, in the order of their kinds, with the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
ORDER = {"assign": 0, "access": 1, "hex": 2, "novel": 3}
#: Texts without any of these have no span of any kind (RE2, wider than the patterns above and below).
MAY_HAVE = r"(?i:passw(?:or)?d|secret|token|api[ _-]?key|pwd|auth|bearer|credential|private[ _-]?key|signature|access[ _-]?key)|AKIA|[0-9a-f]{24}"
#: Words after which a run is a candidate.
SENSITIVE = re.compile(r"password|passwd|pwd|secret|token|api[ _-]?key|auth|bearer|credential|private[ _-]?key|signature|access[ _-]?key", re.IGNORECASE | re.ASCII)
#: Key characters, dots between them included.
RUN = re.compile(r"[A-Za-z0-9+/_-][A-Za-z0-9+/_.-]{18,}[A-Za-z0-9+/_-]={0,2}")
KEY_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----\s+(?:[\w-]+:[^\n]*\n\s*)*((?:[A-Za-z0-9+/]{16,}={0,2}\s+)*[A-Za-z0-9+/]+={0,2})")
#: Characters between a sensitive word and a candidate, and of text around a candidate against which it is measured.
WITHIN, AROUND = 64, 2048
#: Marginal bytes for each character from which a candidate is novel: chosen on names and keys, see the tests.
NOVEL = 0.78
#: Bytes of the dictionary, texts that it is trained on, the level of compression, and lines of each opening.
DICTIONARY_BYTES, SAMPLES, LEVEL, OPENINGS = 250_000, 14_000, 3, (4, 7, 10)
#: Lines of code and text for identifiers to stand in.
LINES = (
    "{0}_{1}_{2}", "{0}-{1}-{2}-{3}", "{0}/{1}/{2}/{3}.py", "{0}.{1}.{2}", "{0}{1:C}{2:C}{3:C}", "{0:U}_{1:U}_{2:U}", "{0} {1} {2} {3} {4}",
    "def {0}_{1}({2}, {3}=None):", "    return self.{0}.{1}({2})", "import {0}.{1}", "const {0}{1:C} = new {2:C}{3:C}();", "public void {0}{1:C}(String {2})", "https://www.{0}.com/{1}/{2}?{3}=1",
)


class _Word(str):
    def __format__(self, how: str) -> str:
        return self.capitalize() if how == "C" else self.upper() if how == "U" else str(self)


@functools.cache
def identifier_dictionary(vocabulary: str, seed: int = 11) -> tuple[bytes, tuple[str, ...]]:
    """A dictionary trained on lines of words of a byte-level vocabulary (.json), frequent ones (of low id) more often,
    and openings of such lines. Made once, on the driver; its size is fixed, whatever the corpus."""
    import zstandard

    entries = json.loads(Path(vocabulary).read_text())["model"]["vocab"]
    ranked = sorted((k, w.lstrip("Ġ").lower()) for w, k in entries.items())
    words = [_Word(w) for w in dict.fromkeys(w for _, w in ranked if w.isascii() and w.isalpha() and 3 <= len(w) <= 14)]
    weights, total = [], 0.0
    for k in range(len(words)):
        total += 1 / (k + 200)
        weights.append(total)
    dice = random.Random(seed)
    line = lambda: dice.choice(LINES).format(*dice.choices(words, cum_weights=weights, k=5))
    samples = ["\n".join(line() for _ in range(6)).encode() for _ in range(SAMPLES)]
    trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8).as_bytes()
    return trained, tuple("".join(line() + "\n" for _ in range(n)) for n in OPENINGS)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each kind; those too short are dropped, but used up."""
    return [
        (m.start(), m.end(), kind)
        for kind, pattern, group, least in KINDS
        for m in pattern.finditer(text)
        if m.end(group) - m.start(group) >= least
    ]


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs after sensitive words, and bodies of private key blocks."""
    found = [m.span(1) for m in KEY_BLOCK.finditer(text)]
    for m in RUN.finditer(text):
        lines = text[max(0, m.start() - WITHIN) : m.start()].split("\n")
        before = lines[-1] if lines[-1].strip(" \t\"'") else "\n".join(lines[-2:])
        if SENSITIVE.search(before) and not any(a <= m.start() and m.end() <= b for a, b in found):
            found.append(m.span())
    return sorted(found)


class Novelty:
    """Marginal bytes under a dictionary; one for each worker process."""

    def __init__(self, dictionary: bytes, openings: tuple[str, ...]) -> None:
        import zstandard

        self.openings = openings
        primed = zstandard.ZstdCompressionDict(dictionary)
        primed.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)

    _workers: dict[int, Novelty] = {}

    @classmethod
    def of(cls, made: tuple[bytes, tuple[str, ...]]) -> Novelty:
        claim("secrets", cls._workers.clear)
        key = hash(made)
        if key not in cls._workers:
            cls._workers[key] = cls(*made)
        return cls._workers[key]

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode("utf-8", "surrogatepass")))

    def of_string(self, found: str, around: str) -> float:
        """Bytes that a string adds to the compressed size of what is around it, for each of its characters.

        Names in capitals are measured in small letters.
        """
        own = found.lower() if found.isupper() else found
        before = [opening + around + "\n" for opening in self.openings]
        return sum(self.size(x + own) - self.size(x) for x in before) / (len(before) * len(found))

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        out = []
        for a, b in candidates(text):
            around = text[max(0, a - AROUND) : a] + text[b : b + AROUND]
            if self.of_string("".join(text[a:b].split()), around) >= NOVEL:
                out.append((a, b, "novel"))
        return out


def secret_spans(text: str, novelty: Novelty) -> list[tuple[int, int, str]]:
    """All spans by start, then kind. A novel one that lies within a base span is left out; one that reaches beyond stays."""
    base = base_spans(text)
    novel = [s for s in novelty.spans(text) if not any(a <= s[0] and s[1] <= b for a, b, _ in base)]
    return sorted([*base, *novel], key=lambda s: (s[0], ORDER[s[2]]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _per_text(docs: DataFrame, vocabulary: str, make, fields: list[pa.Field], extra: list[str], text: str) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(identifier_dictionary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty.of(shipped.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            may = pc.match_substring_regex(column, MAY_HAVE).to_pylist()
            rows = [make(x, secret_spans(s, novelty) if ok and (s := x.as_py()) else []) for x, ok in zip(column, may, strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            made = [pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *(f.name for f in fields)])

    # Columns go by their place, so that no name clashes.
    narrow = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(extra)), F.col(f"`{text}`").cast("string").alias("text"))
    kinds = {pa.int64(): LongType(), pa.string(): StringType()}
    made = [StructField(f.name, kinds[f.type]) for f in fields]
    return narrow.mapInArrow(releasing(run), StructType([*narrow.schema.fields[:-1], *made]))


def find_secrets(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, digest and places of the secrets of each text; places are code points, ends exclusive.

    ``vocabulary`` is the path of a byte-level vocabulary, whose words the dictionary is made of. A null or empty
    text has no secrets (spans is then empty, base_sha256 the digest of the empty string). Rows with equal ids,
    and repeated rows, are scanned each; a null id stays null; other columns, whatever their names, play no
    part; an empty table gives no rows. One pass, no shuffle.
    """

    def make(_, spans):
        base = [s for s in spans if s[2] != "novel"]
        count = [sum(s[2] == k for s in base) for k in ("assign", "access", "hex")]
        return *count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)

    fields = [pa.field(n, pa.int64()) for n in ("n_assign", "n_access", "n_hex")] + [pa.field("base_sha256", pa.string()), pa.field("spans", pa.string())]
    narrow = texts(docs, doc_id, text=text).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return _per_text(narrow, vocabulary, make, fields, ["doc_id"], "text").withColumnRenamed("c0", "doc_id")


def redact_secrets(docs: DataFrame, vocabulary: str, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The same rows and columns with every secret replaced by a mark, and the length in code points renewed.

    A null text and its length stay as they are, and an empty text has nothing to replace. Repeated rows and
    rows of equal ids come out each; other columns keep their values, whatever their names; an empty table gives
    no rows. Only texts with a secret get a new length.
    """
    fields = [pa.field("redacted", pa.string()), pa.field("changed", pa.int64())]
    make = lambda x, spans: (redact(x.as_py(), spans) if spans else x.as_py(), int(bool(spans)))
    others = [c for c in docs.columns if c != text]
    done = _per_text(docs, vocabulary, make, fields, others, text)
    columns = {c: F.col(f"c{k}") for k, c in enumerate(others)} | {text: F.col("redacted").cast(docs.schema[text].dataType)}
    if n_chars in others:
        length = F.char_length("redacted").cast(docs.schema[n_chars].dataType)
        columns[n_chars] = F.when(F.col("changed") == 1, length).otherwise(columns[n_chars])
    return done.select(*(columns[c].alias(c) for c in docs.columns))

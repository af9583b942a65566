"""Operator 12: secrets, by fixed patterns and by what a primed compressor cannot foresee.

Three patterns give the base spans: assignments to a name that says secret, access keys, long hexadecimal runs. Beside
them, a run of key characters soon after a sensitive word is a candidate. zstandard, primed with a dictionary of the
corpus's own identifiers, compresses the text around the candidate without and with it; the marginal bytes for each
of its characters are its novelty. What identifiers, words or the surrounding code make cheap is left alone; what
stays incompressible is reported as a span of kind novel. Base spans are never taken back.

The identifiers are counted in all documents (by rows that hold them). The dictionary is the only thing that leaves
the executors: whole classes of frequency, most frequent first, while they fit DICTIONARY_BYTES. Identifiers of digits
stay out of it, so that a secret that was copied often does not become one of them.

Defined results: null and empty texts have no spans; offsets are code points, the end exclusive; null and repeated
doc_ids and repeated rows are rows of their own; an empty table gives no rows; other columns, whatever their names, are
left out. A candidate is compressed whole, whatever its length, against at most BEFORE and BEHIND characters around it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_only, pieces, text_or_empty

KINDS = ("assign", "access", "hex", "novel")
# fixed patterns and least lengths of the base spans
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 and more, as a shorter run holds no such match
ASSIGNED, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
#: Words that make what follows them a candidate, if it begins within REACH characters.
SENSITIVE = ("password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access key", "access_key", "private key", "private_key", "auth", "bearer", "credential", "signature", "cookie")
REACH = 64
CANDIDATE = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9+/_.-]{15,}[A-Za-z0-9+/_]={0,2}")
SHORTEST = 16
#: Marginal bytes a character from which a candidate is reported. Random letters or digits cost 1; four words of the corpus 0.6 to 0.8.
NOVEL = 0.95
#: Candidates without a digit are reported from this length on: two or three words may cost as much as chance does.
WORDS_FROM = 32
#: A candidate is measured in blocks of at most so many characters, as longer ones get a code for their few kinds of digits.
PORTION = 32
BEFORE, BEHIND = 256, 128
DICTIONARY_BYTES, LEVEL = 64 << 10, 12
#: Bytes that every block begins with.
BLOCK_HEAD = 3
#: Identifiers: ASCII letters and underscores, so many of them.
SHORT_NAME, LONG_NAME = 4, 24
GATHERED = 300_000

_digit = re.compile("[0-9]")
_sensitive = re.compile("|".join(map(re.escape, sorted(SENSITIVE, key=len, reverse=True))), re.IGNORECASE | re.ASCII)
_sensitive_bytes = [w.encode() for w in SENSITIVE]
_assign_bytes = [b"passw", b"secret", b"token", b"api"]
_hex_map = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_name_map = bytes(c if chr(c).isascii() and (chr(c).isalpha() or c == 95) else 32 for c in range(256))
SPANS = "array<struct<kind:string,start:long,end:long,novelty:double>>"


def identifier_counts(docs: DataFrame, text: str = "text", gathered: int = GATHERED) -> DataFrame:
    """name and n, the number of rows whose text holds it, for every identifier of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("novelty-names")
        held: Counter = Counter()

        def some() -> Iterator[pa.RecordBatch]:
            names = list(held)
            for i in range(0, len(names), 50_000):
                part = names[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()).cast(pa.string()), pa.array([held[x] for x in part], pa.int64())], names=["name", "n"])
            held.clear()

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                if t:
                    held.update([w for w in set(t.translate(_name_map).split()) if SHORT_NAME <= len(w) <= LONG_NAME])
                    if len(held) > gathered:
                        yield from some()
        yield from some()

    return docs.select(docs[text].alias("t")).mapInArrow(run, "name string, n long").groupBy("name").agg(F.sum("n").alias("n"))


def identifier_dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY_BYTES) -> bytes:
    """The most frequent identifiers of docs, the most frequent last, where zstandard reaches them most cheaply.

    Classes of frequency are eighths of an octave; the first class that does not fit, and those below it, stay out.
    """
    counted = identifier_counts(docs, text).where("n > 1").withColumn("class", F.floor(F.log2("n") * 8).cast("int")).persist()
    least, total = None, 0
    for r in counted.groupBy("class").agg(F.sum(F.length("name") + 1).alias("bytes")).orderBy(F.desc("class")).collect():  # 512 rows at most
        total += r.bytes
        if total > size:
            break
        least = r["class"]
    names = [] if least is None else counted.where(F.col("class") >= least).orderBy("n", "name").select("name").toArrow().column(0).to_pylist()  # size bytes at most
    counted.unpersist()
    return " ".join(names).encode()


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, str, float | None]]:
    """(start, place of the kind, end, novelty) of the fixed patterns; raw is text in UTF-8."""
    low, out = raw.lower(), []
    if any(w in low for w in _assign_bytes):
        out += [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGNED]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    if b"x" * HEX_LENGTH in raw.translate(_hex_map):
        out += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    return out


def candidates(text: str, raw: bytes) -> list[tuple[int, int]]:
    """(start, end) of the runs that begin soon after a sensitive word."""
    low = raw.lower()
    if not any(w in low for w in _sensitive_bytes):
        return []
    found, seen = {}, -1
    for word in _sensitive.finditer(text):
        at = max(word.end(), seen)
        for m in CANDIDATE.finditer(text, at, word.end() + REACH + SHORTEST):
            if m.start() <= word.end() + REACH and m.start() not in found:
                found[m.start()] = seen = CANDIDATE.match(text, m.start()).end()
    return sorted(found.items())


class Novelty:
    """A compressor primed with a dictionary."""

    def __init__(self, dictionary: bytes, level: int = LEVEL):
        primed = None
        if len(dictionary) >= 8:
            primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            primed.precompute_compress(level=level)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)

    def of(self, text: str, start: int, end: int) -> float:
        """Marginal compressed bytes of text[start:end], for each character, behind the text around it."""
        stream = self.compressor.compressobj()
        stream.compress((text[max(0, start - BEFORE) : start] + text[end : end + BEHIND] + "\n").encode())
        stream.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)  # the candidate's blocks are its own, and may refer to all before them
        own, n = 0, -(-(end - start) // PORTION)
        at = [start + (end - start) * i // n for i in range(n + 1)]
        for a, b in zip(at, at[1:]):
            own += len(stream.compress(text[a:b].encode())) + len(stream.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)) - BLOCK_HEAD
        return own / (end - start)

    def spans(self, text: str | None, least: float = NOVEL) -> list[dict]:
        """All spans of a text, by start, then by kind."""
        if not text:
            return []
        raw = text.encode()
        found = base_spans(text, raw)
        base = sorted((s, e) for s, _, e, _ in found)
        starts, ends = [s for s, _ in base], list(accumulate((e for _, e in base), max))
        for s, e in candidates(text, raw):
            before = bisect_left(starts, e)
            if (before and ends[before - 1] > s) or (e - s < WORDS_FROM and not _digit.search(text, s, e)):
                continue
            x = self.of(text, s, e)
            if x >= least:
                found.append((s, 3, e, x))
        return [{"kind": KINDS[k], "start": s, "end": e, "novelty": x} for s, k, e, x in sorted(found, key=lambda f: f[:3])]


_loaded: dict[bytes, Novelty] = {}


def scan_secrets(docs: DataFrame, dictionary: bytes, least: float = NOVEL) -> DataFrame:
    """doc_id and spans of each row of docs (doc_id, text); each text is scanned where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("novelty", _loaded.clear)
        if dictionary not in _loaded:
            _loaded.clear()
            _loaded[dictionary] = Novelty(dictionary)
        novelty = _loaded[dictionary]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))
        for whole in batches:
            for batch in pieces(whole):
                spans = [novelty.spans(t, least) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def secret_report(docs: DataFrame, least: float = NOVEL) -> DataFrame:
    """One row a document: counts and digest of the base spans, and all spans as kind:start:end."""
    found = scan_secrets(docs, identifier_dictionary(docs), least)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )

"""Operator 2: token ids in binary segments of patched frame-of-reference blocks.

A segment holds whole documents in order. Its ids are cut into blocks of BLOCK; a block stores its
minimum, the bit width that fits PERCENTILE of its differences from the minimum, the differences packed
at that width, and a list of the exceptions that need more bits. An index has each block's start, so a
range of ids is read without the blocks before it. Spark's Parquet writer commits the segments, one row
each, so a lost or repeated task leaves no part of a file behind.

Segment layout, little-endian: magic, counts (documents, of them without an id, ids, blocks, packed
words, exceptions), document ids i64, ids per document u32, block minima u32, block widths u8, block
starts in packed words u64, starts in the exception list u32 (one more than blocks), exception places
u16, exception values u32, packed words u64.

Defined results: null and empty texts hold the end id alone; a null doc_id comes before all others;
repeated ids keep the order of their texts; other columns are left out.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import keep_only, parallelism, pieces, scratch

MAGIC = b"PFR1"
BLOCK, LANES = 256, 64
PERCENTILE = 0.9
#: Ids that a segment takes before the next begins; a document is never split.
SEGMENT_IDS = 1_000_000
CACHED_PIECES = 800_000
SEGMENTS = "part int, segment int, n_ids long, before long, image binary"


def bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of LANES values as rows of width 64-bit words."""
    out = np.zeros((len(values), width), np.uint64)
    for lane in range(LANES):
        word, shift = divmod(lane * width, 64)
        out[:, word] |= values[:, lane] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= values[:, lane] >> np.uint64(64 - shift)
    return out


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.empty((len(words), LANES), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for lane in range(LANES):
        word, shift = divmod(lane * width, 64)
        v = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | words[:, word + 1] << np.uint64(64 - shift)
        out[:, lane] = v & mask
    return out


def write_segment(doc_ids: list[int | None], per_doc: np.ndarray, ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """The image of a segment; documents without an id come first."""
    n, no_id = len(ids), sum(d is None for d in doc_ids)
    blocks = -(-n // BLOCK)
    grid = np.empty(blocks * BLOCK, np.uint64)
    grid[:n] = ids
    grid[n:] = ids[-1] if n else 0
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.uint64)
    delta = grid - low[:, None]
    bits = bit_lengths(delta)
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    widths = np.partition(bits, at, axis=1)[:, at] if blocks else np.zeros(0, np.uint8)
    starts = np.zeros(blocks + 1, np.uint64)
    np.cumsum(widths.astype(np.uint64) * np.uint64(BLOCK // LANES), out=starts[1:])
    words = np.zeros(int(starts[-1]), np.uint64)
    odd = bits > widths[:, None]
    exc_block, exc_place = np.nonzero(odd)
    exc_starts = np.zeros(blocks + 1, np.uint32)
    np.cumsum(np.bincount(exc_block, minlength=blocks), out=exc_starts[1:])
    for w in np.unique(widths).tolist():
        if w:
            rows = np.flatnonzero(widths == w)
            own = pack((delta[rows] & np.uint64((1 << w) - 1)).reshape(-1, LANES), w)
            place = starts[rows].astype(np.int64)[:, None] + np.arange(w * BLOCK // LANES)
            words[place.ravel()] = own.ravel()
    head = MAGIC + struct.pack("<6Q", len(doc_ids), no_id, n, blocks, len(words), len(exc_block))
    parts = (np.array([d or 0 for d in doc_ids], "<i8"), per_doc.astype("<u4"), low.astype("<u4"), widths.astype("u1"), starts[:-1].astype("<u8"), exc_starts.astype("<u4"), exc_place.astype("<u2"), delta[odd].astype("<u4"), words.astype("<u8"))
    return head + b"".join(p.tobytes() for p in parts)


class Segment:
    """A segment's image, opened for reading."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a token segment")
        docs, self.no_id, self.n, blocks, words, exceptions = struct.unpack_from("<6Q", image, 4)
        at = 4 + 48

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(image, kind, count, at)
            at += got.nbytes
            return got

        self.doc_ids, self.per_doc = take("<i8", docs), take("<u4", docs)
        self.low, self.widths, self.starts = take("<u4", blocks), take("u1", blocks), take("<u8", blocks)
        self.exc_starts, self.exc_place, self.exc_value = take("<u4", blocks + 1), take("<u2", exceptions), take("<u4", exceptions)
        self.words = take("<u8", words)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids from first up to last, from their own blocks alone."""
        last = self.n if last is None else last
        a, b = first // BLOCK, -(-last // BLOCK)
        grid = np.zeros((max(b - a, 0), BLOCK), np.uint64)
        widths = self.widths[a:b]
        for w in np.unique(widths).tolist():
            if w:
                rows = np.flatnonzero(widths == w)
                place = self.starts[a:b][rows].astype(np.int64)[:, None] + np.arange(w * BLOCK // LANES)
                grid[rows] = unpack(self.words[place].reshape(-1, w), w).reshape(-1, BLOCK)
        lo, hi = int(self.exc_starts[a]), int(self.exc_starts[max(a, b)])
        block = np.repeat(np.arange(max(b - a, 0)), np.diff(self.exc_starts[a : max(a, b) + 1]))
        grid[block, self.exc_place[lo:hi]] = self.exc_value[lo:hi]
        grid += self.low[a:b].astype(np.uint64)[:, None]
        return grid.ravel()[first - a * BLOCK : last - a * BLOCK].astype(np.uint32)


class PieceEncoder:
    """The tokenizers library over the distinct pieces of texts, cut where a space follows anything but white space.

    The vocabulary's pattern never lets a token cross such a place, so the pieces' ids are the text's own. New
    pieces are encoded together: pre-tokens of plain letters, digits and signs by the library's model, pieces
    with signs beyond LATEST, or odd white space, by its whole pipeline.
    """

    LATEST = "\u052f"
    #: Pre-tokens that the model takes at once, parted by a byte that no merge has.
    AT_ONCE = 64

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.special = regex.compile("|".join(regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        spelling, long = byte_symbols(), "".join(t for t in self.tokenizer.get_vocab() if len(t) > 1)
        # bytes that UTF-8 never has
        self.stop = next((b for b in (0xC0, 0xC1, *range(0xF5, 0x100)) if spelling[b] not in long), None)
        self.stop_id = None if self.stop is None else self.tokenizer.token_to_id(spelling[self.stop])
        self.spelling = dict(enumerate(spelling))
        self.blanks = [c + " " for c in map(chr, range(0x3001)) if c.isspace()]
        self.ascii_blanks = [b for b in self.blanks if b.isascii()]
        self.cuts = regex.compile(r"(?<=[^\s\x1c-\x1f])(?= )")
        # the vocabulary's own pattern, and the pieces on which all engines read it alike
        self.pre_tokens = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.plain = regex.compile(r"[^\x0b\x0c\x1c-\x1f\x85\xa0\0]+")
        self.known: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn_pre_tokens(self, new: list[str]) -> None:
        """Encode pre-tokens by the library's model."""
        known, many = self.known, 1 if self.stop_id is None else self.AT_ONCE
        stop = b"" if self.stop is None else bytes([self.stop])
        for i in range(0, len(new), many):
            some = new[i : i + many]
            text = stop.join([p.encode() for p in some]).decode("latin-1").translate(self.spelling)
            ids = array("I", [t.id for t in self.model.tokenize(text)])
            raw, ends = ids.tobytes(), [len(ids)]
            if len(some) > 1:
                ends = [*np.flatnonzero(np.frombuffer(raw, "<u4") == self.stop_id).tolist(), len(ids)]
            at = 0
            for p, z in zip(some, ends, strict=True):
                known[p] = raw[4 * at : 4 * z]
                at = z + 1

    def learn(self, new: set[str]) -> None:
        """Encode pieces that are not known yet."""
        alone, made, rest = [], {}, []
        for p in new:
            core = p[1:] if p[:1] == " " else p
            if not (core.isascii() or max(core) <= self.LATEST):
                rest.append(p)
            elif core.isalpha():
                alone.append(p)
            elif core[-1:] in (",", ".") and core[:-1].isalpha():
                made[p] = (p[:-1], p[-1])
            elif self.plain.fullmatch(p) and not self.special.search(p):
                made[p] = self.pre_tokens.findall(p)
            else:
                rest.append(p)
        known = self.known
        self.learn_pre_tokens(list({x for parts in made.values() for x in parts if x not in known}.union(alone)))
        for p, parts in made.items():
            known[p] = b"".join([known[x] for x in parts])
        known.update(zip(rest, self.library(rest), strict=True))

    def pieces_of(self, text: str) -> list[str]:
        if self.special.search(text):
            return [text]
        if text.startswith(" ") or "\0" in text or any(b in text for b in (self.ascii_blanks if text.isascii() else self.blanks)):
            return self.cuts.split(text)
        return text.replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
        split = [self.pieces_of(t) for t in texts]
        self.learn(set().union(*split).difference(self.known))
        return [b"".join(map(self.known.__getitem__, row)) for row in split]


_loaded: dict[str, PieceEncoder] = {}


def loaded(path: str) -> PieceEncoder:
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int, segment_ids: int = SEGMENT_IDS) -> None:
    """Write the token segments of docs (doc_id, text) in ascending doc_id order to the table at out."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = loaded(path), TaskContext.get().partitionId()
        keep_only("tokenfile", _loaded.clear)
        doc_ids: list[int | None] = []
        rows: list[bytes] = []
        number = held = before = 0

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(rows), "<u4")
            image = write_segment(doc_ids, np.array([len(r) // 4 for r in rows]), ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([before], pa.int64()), pa.array([image], pa.binary())], names=["part", "segment", "n_ids", "before", "image"])

        for whole in batches:
            for batch in pieces(whole):
                for d, ids in zip(batch.column(0).to_pylist(), encoder.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    doc_ids.append(d)
                    rows.append(ids + end)
                    held += len(rows[-1]) // 4
                    if held >= segment_ids:
                        yield segment()
                        before, number, held = before + held, number + 1, 0
                        doc_ids.clear()
                        rows.clear()
        if rows:
            yield segment()

    # by the texts' first letters as well, so that rows without an id, or of one id, are not one task
    ordered = docs.select("doc_id", "text").repartitionByRange(parallelism(docs.sparkSession), "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SEGMENTS).write.parquet(out)


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """One row a document of the segments at path: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    # one row for each partition of the write, so that this window and the broadcast stay small
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    first = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, start in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                s = Segment(image.as_py())
                all_ids = s.ids()
                ends = np.cumsum(s.per_doc.astype(np.int64))
                raw, starts = all_ids.astype("<u4").tobytes(), ends - s.per_doc
                doc_ids = pa.array(s.doc_ids, mask=np.arange(len(s.doc_ids)) < s.no_id)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [doc_ids, pa.array(starts + start), pa.array(s.per_doc.astype(np.int64)), pa.array(crc, pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(all_ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    return files.join(F.broadcast(first), "part").select("image", (F.col("first") + F.col("before")).alias("start")).mapInArrow(run, schema)


def token_digest(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write docs' token segments into the shared folder and read them back."""
    spark = docs.sparkSession
    out = scratch(spark, "tokens")
    write_tokens(docs, path, out, end_id)
    return read_tokens(spark, out)

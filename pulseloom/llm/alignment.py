"""Operator 13: groups of tokens of two tokenizers that cover the same bytes, and how often their tokens end together.

Every byte of a text gets a label: no token ends there (0), one of A (1), one of B (2), one of both (3). A regular
expression over the labels takes the spans up to each 3; the labels counted in a span say how many tokens of A
and of B form the group. Texts are cut into units first, where a single space stands between two signs that are
not white space: neither vocabulary has a token across such a place (checked when it is loaded, otherwise a text is
one unit), so that a unit's groups are the same in every text, and a worker keeps those of the units it has met.

A link joins the tokens of A and B that end on one byte. Links are written beside each text as one number for a
pair of ids and counted over the corpus. Counts come back to the texts in two ways: those of the most frequent pairs,
at most FREQUENT of them, are broadcast; links of rarer pairs, of which each is rare by definition, are joined by a
shuffle. The best count of an id of B is joined by that id (a row for each entry of B's vocabulary).

Defined results: null and empty texts, and texts that either vocabulary does not give back byte by byte (B
changes U+2581 into a space), have no tokens, groups or links, and an empty digest; special tokens' strings are plain
text; null and repeated doc_ids and repeated rows are rows of their own, and each counts; an empty table gives no
rows; other columns, whatever their names, are left out. A long text is aligned in blocks of BLOCK characters, cut
between units.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import keep_only, list_of, pieces, scratch

#: Units that a worker keeps (some 400 bytes each) in two halves, the newer of which takes over what is met again,
#: and the longest unit that is kept.
CACHED_UNITS, LONGEST_KEPT = 100_000, 80
#: Bytes of texts whose units are looked up and learned together.
BATCH = 1 << 20
#: Units that A encodes as one text.
TOGETHER = 500
#: Characters of a text that are aligned at once.
BLOCK = 1 << 20
#: Pairs of ids whose counts are broadcast, 17 bytes each.
FREQUENT = 1_000_000
#: Distinct pairs that a task gathers before it passes them on.
GATHERED = 2_000_000
BOTH = re.compile(rb"[^\x03]*\x03", re.DOTALL)
#: A space that opens a unit stands alone and before a sign; Python's white space holds that of both vocabularies.
UNIT = re.compile(r"(?<! ) (?=\S)")
ODD_SPACE = re.compile(r" (?:\s|\Z)")
STOPS = ".,"
LOW = (1 << 32) - 1


class Aligner:
    """Two vocabularies: A, a byte-level BPE (tokenizers' JSON), and B, a sentencepiece model."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: i for i, c in enumerate(byte_symbols())}
        spelt = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.a_bytes = [spelt.get(i, b"") for i in range(max(spelt) + 1)]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        if not all(spelt.values()) or not all(self.b_bytes):
            raise ValueError("a token without bytes has no place in a text")
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        # an id's digits and what follows them within a group and at the end of its side
        self.a_name, self.b_name = (np.array([[b"%d%s" % (i, c) for i in range(len(x))] for c in (b",", end)], object) for x, end in ((self.a_bytes, b"|"), (self.b_bytes, b";")))
        self.cuttable = self._plain(a_path) and not any("▁" in p.lstrip("▁") or (len(p) > 1 and "\n" in p) for p in names)
        # no token of B has a letter before a stop, and A never joins them
        self.stops = not any(x.isalpha() and y in STOPS for p in names for x, y in zip(p, p[1:]))
        self.known: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}  # what was known before known was begun anew
        self.bare: dict[str, tuple] = {}  # line feeds, and lines and stops that have no space before them
        self.long: list[tuple[dict, str]] = []  # what is too long to be kept

    @staticmethod
    def _plain(path: str) -> bool:
        """Whether A parts texts by the usual byte-level pattern and nothing else."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        return spec["normalizer"] is None and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space")

    def ids_a(self, texts: list[str], spaced: bool, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of A of all texts, number of each one's), with a space before each text or without; size is their bytes.

        Units are encoded many at a time, one behind the other: A parts them by itself, and their bytes say where.
        """
        if spaced and self.cuttable and not any(not t or t[0].isspace() for t in texts):
            runs = [" " + " ".join(texts[i : i + TOGETHER]) for i in range(0, len(texts), TOGETHER)]
            flat = np.fromiter(chain.from_iterable(e.ids for e in self.a.encode_batch_fast(runs, add_special_tokens=False)), np.int64)
            ends, upto = np.cumsum(self.a_size[flat]), np.cumsum(size)
            at = np.minimum(np.searchsorted(ends, upto), max(len(ends) - 1, 0))
            if len(ends) and ends[-1] == upto[-1] and (ends[at] == upto).all():
                return flat, np.diff(np.r_[0, at + 1])
        return flattened([e.ids for e in self.a.encode_batch_fast([" " + t if spaced else t for t in texts], add_special_tokens=False)])

    def ids_b(self, texts: list[str], spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """The same of B."""
        if spaced:
            return flattened(self.b.encode(texts, num_threads=1))
        # B puts a space before every text: of "\nabc" the first two tokens are that space and the line feed
        return flattened([ids[2:] for ids in self.b.encode(["\n" + t for t in texts], num_threads=1)])

    def align(self, texts: list[str], spaced: bool = True) -> list[tuple | None]:
        """(groups, links, counts) of each text taken by itself; None where the bytes differ.

        groups is "a1,a2|b1;a3|b2,b3;"; links are ids of A times 2^32 plus ids of B; counts is tokens of A plus
        tokens of B times 2^32.
        """
        raw = [(" " + t if spaced else t).encode() for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        good = np.ones(len(raw), bool)
        whole = b"".join(raw)
        sides = []
        for (flat, n), sizes, spelt in ((self.ids_a(texts, spaced, size), self.a_size, self.a_bytes), (self.ids_b(texts, spaced), self.b_size, self.b_bytes)):
            ends, upto = np.cumsum(sizes[flat]), np.cumsum(n)
            good &= np.diff(np.r_[0, np.r_[0, ends][upto]]) == size
            if good.all() and b"".join(map(spelt.__getitem__, flat.tolist())) != whole:
                good &= [b"".join(map(spelt.__getitem__, x.tolist())) == r for x, r in zip(np.split(flat, upto[:-1]), raw, strict=True)]
            sides.append((flat, ends, n))
        if not good.all():  # the others once more, without them
            rest = iter(self.align([t for t, ok in zip(texts, good, strict=True) if ok], spaced) if good.any() else ())
            return [next(rest) if ok else None for ok in good]
        (flat_a, a_ends, n_a), (flat_b, b_ends, n_b) = sides
        labels = np.zeros(len(whole), np.uint8)
        labels[a_ends - 1] += 1
        labels[b_ends - 1] += 2
        spans = np.fromiter(map(len, BOTH.findall(labels.tobytes())), np.int64)
        starts = np.cumsum(spans) - spans
        in_a, in_b = ((np.add.reduceat((labels == x).astype(np.int64), starts) if len(starts) else starts) + 1 for x in (1, 2))
        first = np.cumsum(in_a + in_b) - in_a - in_b
        names = np.empty(len(flat_a) + len(flat_b), object)
        last = []
        for flat, count, at, name in ((flat_a, in_a, first, self.a_name), (flat_b, in_b, first + in_a, self.b_name)):
            nth = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
            ends = nth == np.repeat(count, count) - 1
            names[np.repeat(at, count) + nth] = name[ends.astype(np.int64), flat]
            last.append(flat[ends])
        links = ((last[0] << 32) | last[1]).astype("<i8").tobytes()
        names = names.tolist()
        tokens = np.cumsum(n_a + n_b)
        groups = np.searchsorted(starts, np.cumsum(size)) * 8
        out, x, i = [], 0, 0
        for y, j, c in zip(tokens.tolist(), groups.tolist(), (n_a | n_b << 32).tolist(), strict=True):
            out.append((b"".join(names[x:y]), links[i:j], c))
            x, i = y, j
        return out

    def units(self, text: str) -> list[str]:
        """text, with a space before it, in units, each without the space that opens it."""
        if not self.cuttable:
            return [text]
        if text[:1].isspace() or "  " in text or ODD_SPACE.search(text):
            first, *rest = UNIT.split(" " + text)
            return [first[1:], *rest] if first else rest
        return text.split(" ")

    def parts(self, unit: str) -> list[str]:
        """A unit cut around line feeds between two signs, and before the stops at the end of a line of letters."""
        lines = unit.split("\n")
        if len(lines) > 1 and any(x == "" or x[:1].isspace() or x[-1:].isspace() for x in lines):
            return [unit]
        out = []
        for k, line in enumerate(lines):
            if k:
                out.append("\n")
            core = line.rstrip(STOPS)
            if self.stops and core != line and core.isalpha():
                out += [core, line[len(core) :]]
            else:
                out.append(line)
        return out

    def learn(self, new: set[str]) -> None:
        """Align units that are not known yet; those of several parts are put together from these."""
        whole, made, bare = set(), {}, set()
        for u in new:
            if u.isalpha():  # nothing to part
                whole.add(u)
                continue
            first, *rest = self.parts(u) if self.cuttable else [u]
            if rest:
                made[u] = (first, rest)
                bare.update(rest)
            if first not in self.known:
                whole.add(first)
        for into, todo, spaced in ((self.known, list(whole), True), (self.bare, [x for x in bare if x not in self.bare], False)):
            for i in range(0, len(todo), 20_000):
                some = todo[i : i + 20_000]
                into.update(zip(some, self.align(some, spaced), strict=True))
                self.long += [(into, t) for t in some if len(t) > LONGEST_KEPT]
        for u, (first, rest) in made.items():
            found = [self.known[first], *map(self.bare.__getitem__, rest)]
            self.known[u] = None if None in found else joined(found)
            if len(u) > LONGEST_KEPT:
                self.long.append((self.known, u))

    def look_up(self, split: list[list[str]]) -> list[list[tuple] | None]:
        """What is known of each unit of some texts; None for a text with a unit that is not given back."""
        new = set().union(*split).difference(self.known)
        if again := new.intersection(self.old):
            self.known.update((u, self.old[u]) for u in again)
            new -= again
        if new:
            self.learn(new)
        found = [list(map(self.known.__getitem__, units)) for units in split]
        for into, u in self.long:
            into.pop(u, None)
        self.long.clear()
        if len(self.known) > CACHED_UNITS // 2:
            self.old, self.known = self.known, {}
        if len(self.bare) > CACHED_UNITS // 4:
            self.bare.clear()
        return [None if None in x else x for x in found]

    def blocks(self, text: str, most: int = BLOCK) -> Iterator[str]:
        """text in runs of whole units of at least so many characters each, without the space between two runs."""
        at = 0
        while self.cuttable and len(text) - at > most:
            cut = UNIT.search(text, at + most)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.end()
        yield text[at:]

    def texts(self, texts: list[str | None], most: int = BLOCK) -> Iterator[list[tuple[bytes, bytes, int]]]:
        """(groups, links, counts) of the blocks of each text; none for a text that is not given back."""
        short = [t for t in texts if t and len(t) <= most]
        ready = iter(self.look_up([self.units(t) for t in short]))
        for t in texts:
            if not t:
                yield []
                continue
            found = [next(ready)] if len(t) <= most else [self.look_up([self.units(b)])[0] for b in self.blocks(t, most)]
            if None in found:  # some unit is not: the bytes of the whole decide
                whole = self.align([t])[0]
                found = [[whole]] if whole else []
            yield [joined(units) for units in found]


def flattened(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())), n


def joined(found: list[tuple]) -> tuple[bytes, bytes, int]:
    return b"".join([x[0] for x in found]), b"".join([x[1] for x in found]), sum([x[2] for x in found])


_loaded: dict[tuple[str, str], Aligner] = {}


def loaded(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Aligner(a_path, b_path)
    return _loaded[a_path, b_path]


def align_tokens(docs: DataFrame, a_path: str, b_path: str, digest: bool = False, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, groups and links of each row of docs (doc_id, text).

    groups is "a1,a2|b1;a3|b2,b3", ids of A and of B in order; with digest, its SHA-256 stands in place of it, so that
    no text of that length leaves the worker. links are pairs of ids, A's times 2^32 plus B's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = loaded(a_path, b_path)
        keep_only("alignment", _loaded.clear)
        for whole in batches:
            for batch in pieces(whole, BATCH):
                counts, groups, links = [], [], []
                for found in aligner.texts(batch.column(1).to_pylist(), block):
                    g, l, n = joined(found)
                    counts.append(n)
                    groups.append((hashlib.sha256(memoryview(g)[:-1]).hexdigest() if g else "") if digest else g[:-1].decode())
                    links.append(np.frombuffer(l, "<i8"))
                n = np.array(counts, np.int64)
                cols = [batch.column(0), pa.array(n & LOW), pa.array(n >> 32), pa.array(groups, pa.string()), list_of(links, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_a", "n_b", "groups", "links"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_a long, n_b long, groups string, links array<long>")


def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes with the sums of their counts."""
    c, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(c, kind="stable")
    c, n = c[order], n[order]
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, np.int64)
    return c[first], np.add.reduceat(n, first) if len(c) else n


def pair_counts(aligned: DataFrame, most: int = GATHERED) -> DataFrame:
    """code, n and best: how many links of the corpus hold each pair of ids, and whether no pair with its id of B has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("alignment-counts")
        codes, counts, held, merged = [], [], 0, 0
        for batch in batches:
            c, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            codes.append(c)
            counts.append(n)
            held += len(c)
            if held > 2 * merged + most:
                c, n = summed(codes, counts)
                codes, counts, merged, held = [c], [n], len(c), len(c)
                if merged > most:
                    yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n)], names=["code", "n"])
                    codes, counts, merged, held = [], [], 0, 0
        if codes:
            c, n = summed(codes, counts)
            for i in range(0, len(c), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]), pa.array(n[i : i + 100_000])], names=["code", "n"])

    pairs = aligned.select("links").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    pairs = pairs.withColumn("b", F.col("code").bitwiseAND(F.lit(LOW)))
    top = pairs.groupBy("b").agg(F.max("n").alias("most"))  # a row for each entry of B's vocabulary
    return pairs.join(F.broadcast(top), "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, pairs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """aligned with n_best and count_sum in place of links. Both are read from written tables; row tells rows apart."""
    sizes = pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("bits")).agg(F.count("*").alias("pairs")).collect()  # 64 rows at most
    least, total = 64, 0
    for r in sorted(sizes, key=lambda r: -r.bits):
        total += r.pairs
        if total > frequent:
            break
        least = r.bits
    is_frequent = F.floor(F.log2("n")) >= least
    kept = pairs.where(is_frequent).toArrow()  # at most so many
    rest = total > frequent
    codes = kept.column("code").to_numpy()
    order = np.argsort(codes)
    table = aligned.sparkSession.sparkContext.broadcast((codes[order], kept.column("n").to_numpy()[order], kept.column("best").to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("alignment-counts")
        codes, counts, best = table.value
        for batch in batches:
            links = batch.column(batch.num_columns - 1)
            flat, ends = links.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.r_[0, links.value_lengths().to_numpy(zero_copy_only=False)])
            at = np.minimum(np.searchsorted(codes, flat), max(len(codes) - 1, 0))
            hit = codes[at] == flat if len(codes) else np.zeros(len(flat), bool)
            in_all = lambda x: np.diff(np.r_[0, np.cumsum(x)][ends])
            n = np.where(hit, counts[at], 0) if len(codes) else np.zeros(len(flat), np.int64)
            b = (hit & best[at]).astype(np.int64) if len(codes) else n
            gone = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(~hit)][ends].astype(np.int32)), pa.array(flat[~hit], pa.int64()))
            cols = [*batch.columns[:-1], pa.array(np.diff(ends)), pa.array(in_all(b)), pa.array(in_all(n)), gone]
            yield pa.RecordBatch.from_arrays(cols, names=[*through, "n_links", "n_best", "count_sum", "rare"])

    through = [c for c in aligned.columns if c != "links"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name != "links")
    out = aligned.select(*through, "links").mapInArrow(run, f"{schema}, n_links long, n_best long, count_sum long, rare array<long>")
    if not rest:
        return out.drop("rare")
    path = scratch(aligned.sparkSession, "alignment-rare")
    out.write.parquet(path)
    out = aligned.sparkSession.read.parquet(path)
    more = out.select("row", F.explode("rare").alias("code")).join(pairs.where(~is_frequent), "code")
    more = more.groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("best").cast("long")).alias("more_best"))
    out = out.join(more, "row", "left")
    return out.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))}).drop("rare", "more", "more_best")


def alignment_report(docs: DataFrame, a_path: str, b_path: str, frequent: int = FREQUENT) -> DataFrame:
    """One row a document: its tokens, groups and links, and how often the corpus links the same ids."""
    spark = docs.sparkSession
    path = scratch(spark, "alignment")
    align_tokens(docs, a_path, b_path, digest=True).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    aligned = spark.read.parquet(path)
    counted = scratch(spark, "alignment-pairs")
    pair_counts(aligned).write.parquet(counted)
    out = with_counts(aligned, spark.read.parquet(counted), frequent)
    return out.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))

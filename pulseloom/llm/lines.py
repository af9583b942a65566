"""Operator 5: line dedup by a deletion-neighbourhood join.

Lines are compared as word sequences. A line repeats another if they are equal or if one word inserted,
deleted or replaced turns one into the other, as long as that leaves SIMILARITY of the shorter one's words
or more (0.8: lines of five words and up; in a shorter line one word is too much of it, and it must be
equal). Edits are counted in words and not in letters, as lines are templates that differ in a name, a
number or a date, of whatever length. Of lines that repeat one another the earliest stays: a line goes if
an earlier one, by doc_id and place, is within the bound, whether or not that one stays itself.

Equal lines meet by a hash of their words and are one class from there on. Each class emits all its
one-word-deletion variants, and itself, as hashed keys; classes whose keys are equal are candidates, whose
edit distance is verified on the words. Two lines within the bound share a half, at the same place from
the left or the right, so classes that share no half with another emit no variants; none is lost by that.

Defined results: blank lines are kept and match nothing; null texts stay null; a text whose lines all go
becomes empty; null doc_ids come after all others; rows that repeat doc_id and text count as one document
and fare alike; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, carried, cut, keep_only, parallelism, pieces, scratch, unfolded

#: What one edit must leave of a line, and the words that a line has at least where it does.
SIMILARITY = 0.8
MIN_WORDS = round(1 / (1 - SIMILARITY))
#: Bytes of a broadcast row beside its list, of a line's number in a list, and of a pair of line and id.
ROW_BYTES, NUMBER_BYTES, PAIR_BYTES = 96, 4, 32
CACHED_WORDS = 300_000
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mixed(h: np.ndarray, tag: np.ndarray | int) -> np.ndarray:
    """Hashes with a tag worked in."""
    with np.errstate(over="ignore"):
        h = (h ^ (np.asarray(tag, np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


class WordHasher:
    """Hashes of word ranges: sums of word hashes times powers of BASE, so that any range costs two lookups."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.power = self.inverse = np.ones(1, np.uint64)

    def forget(self) -> None:
        self.known.clear()
        self.power = self.inverse = self.sums = np.ones(1, np.uint64)

    def hashes(self, lines: list[list[str]]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        flat: list[int | None] = []
        for words in lines:
            got = list(map(known.get, words))
            if None in got:
                for w in words:
                    if w not in known:
                        known[w] = xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
                got = list(map(known.get, words))
            flat += got
        return np.array(flat, np.uint64)

    def load(self, lines: list[list[str]]) -> None:
        keep_only("lines", self.forget)
        w = self.hashes(lines)
        if len(self.power) <= len(w):
            n = len(w) + len(w) // 4 + 1
            with np.errstate(over="ignore"):
                self.power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)])
                self.inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, BASE_INVERSE, np.uint64)])
        self.sums = np.zeros(len(w) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(w * self.power[: len(w)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def without(self, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the range without the word at."""
        with np.errstate(over="ignore"):
            left = self.sums[at] - self.sums[start]
            return (left + (self.sums[end] - self.sums[at + 1]) * np.uint64(BASE_INVERSE)) * self.inverse[start]


_hasher = WordHasher()


def half_keys(hasher: WordHasher, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Keys of both halves, cut as for this length and as for the length one less; 0 where too short."""
    n, out = end - start, []
    for m in (n, n - 1):
        p, fit = np.maximum(m, 0) // 2, m >= MIN_WORDS
        left = mixed(hasher.of(start, start + p), 2 * np.maximum(m, 0))
        right = mixed(hasher.of(end - (np.maximum(m, 0) - p), end), 2 * np.maximum(m, 0) + 1)
        out += [np.where(fit, left | np.uint64(1), 0), np.where(fit, right | np.uint64(1), 0)]
    return out


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether the edit distance of two word lists is 1 at most."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _keyed(docs: DataFrame, through: list[str]) -> DataFrame:
    """doc_id, text, doc_key (of both) and row, the columns of docs that go through."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("doc_key"), carried(through))


def small(df: DataFrame, lists: str, entry_bytes: int) -> DataFrame:
    """df, to be broadcast if it is few bytes by its rows and the entries of a list column."""
    n, entries = df.agg(F.count("*"), F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()
    return F.broadcast(df) if n * ROW_BYTES + entries * entry_bytes <= BROADCAST_BYTES else df


HALVES = ["k1", "k2", "k3", "k4"]
LINES = "doc_id long, doc_key long, line int, words int, h long, k1 long, k2 long, k3 long, k4 long"


def line_table(docs: DataFrame) -> DataFrame:
    """A row for each line with words: its document and place, number of words, hash and half keys (0: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                lines: list[list[str]] = []
                row: list[int] = []
                place: list[int] = []
                for r, t in enumerate(batch.column(2).to_pylist()):
                    for k, line in enumerate((t or "").split("\n")):
                        if words := line.split():
                            lines.append(words)
                            row.append(r)
                            place.append(k)
                _hasher.load(lines)
                n = np.fromiter(map(len, lines), np.int64, len(lines))
                end = np.cumsum(n)
                start = end - n
                h = mixed(_hasher.of(start, end), n).view(np.int64)
                at = pa.array(np.array(row, np.int64))
                cols = [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.array(place, np.int32)), pa.array(n.astype(np.int32)), pa.array(h)]
                cols += [pa.array(k.astype(np.uint64).view(np.int64)) for k in half_keys(_hasher, start, end)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "doc_key", "line", "words", "h", "k1", "k2", "k3", "k4"])

    return docs.select("doc_id", "doc_key", "text").mapInArrow(run, LINES)


def sharing_a_half(classes: DataFrame, n: int) -> DataFrame:
    """The hashes of the lines, once each in classes, that share a half key with a different line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, 0  # of the group that may go on
        for batch in batches:
            k, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            starts = np.r_[True, k[1:] != k[:-1]]
            lead = h[np.maximum.accumulate(np.where(starts, np.arange(len(k)), 0))]
            if key is not None and k[0] == key:
                lead[k == key] = first
            other = h != lead
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.r_[h[other], lead[other]]))], names=["h"])
            key, first = k[-1], lead[-1]

    keys = classes.select("h", F.explode(F.array("k1", "k2", "k3", "k4")).alias("k")).where("k != 0").select("k", "h")
    return keys.repartition(n, "k").sortWithinPartitions("k", "h").mapInArrow(run, "h long").distinct()


def candidate_texts(docs: DataFrame, cand: DataFrame) -> DataFrame:
    """id, and the line itself, of the candidates (id, doc_key, line), read again from docs."""
    per_doc = cut(cand.groupBy("doc_key").agg(F.collect_list(F.struct("line", "id")).alias("at")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for t, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = (t or "").split("\n")
                ids += [x["id"] for x in at]
                found += [lines[x["line"]] for x in at]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["id", "content"])

    met = docs.select("doc_key", "text").join(small(per_doc, "at", PAIR_BYTES), "doc_key")
    return met.select("text", "at").mapInArrow(run, "id long, content string").dropDuplicates(["id"])


def witnesses(texts: DataFrame, n: int) -> DataFrame:
    """(id, other): for lines that share a deletion variant with an earlier line, the earliest such line."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                lines = [c.split() for c in batch.column(1).to_pylist()]
                _hasher.load(lines)
                n = np.fromiter(map(len, lines), np.int64, len(lines))
                end = np.cumsum(n)
                start = end - n
                of = np.repeat(np.arange(len(lines)), n)
                at = np.arange(len(of))
                ids = batch.column(0).to_numpy()
                cut_ = mixed(_hasher.without(start[of], end[of], at), n[of] - 1)
                own = mixed(_hasher.of(start, end), n)
                key = np.r_[cut_, own].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.r_[ids[of], ids]), pa.array(np.r_[at - start[of], np.full(len(ids), -1)].astype(np.int32))], names=["k", "id", "at"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        first: dict[int, int] = {}  # of the group at hand: the earliest line for each deleted place, -1 the line itself, -2 any deletion
        for batch in batches:
            k = batch.column(0).to_numpy()
            if not len(k):
                continue
            # rows alone with their key have no partner; the first and last may have one in another batch
            alone = np.r_[False, k[1:] != k[:-1]] & np.r_[k[1:] != k[:-1], False]
            some = np.flatnonzero(~alone)
            ids, at = batch.column(1).to_numpy()[some], batch.column(2).to_numpy()[some]
            a, b = [], []
            for x, i, p in zip(k[some].tolist(), ids.tolist(), at.tolist(), strict=True):
                if x != key:
                    key, first = x, {}
                others = [first[q] for q in ((-2,) if p == -1 else (p, -1)) if q in first]
                if others and (o := min(others)) < i:
                    a.append(i)
                    b.append(o)
                first.setdefault(p, i)
                if p >= 0:
                    first.setdefault(-2, i)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["id", "other"])

    met = texts.select("id", "content").mapInArrow(emit, "k long, id long, at int")
    found = met.repartition(n, "k").sortWithinPartitions("k", "id").mapInArrow(meet, "id long, other long")
    return found.groupBy("id").agg(F.min("other").alias("other"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ids of pairs whose lines are within one edit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [within_one(a.split(), b.split()) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_()))], names=["id"])

    other = texts.select(F.col("id").alias("other"), F.col("content").alias("content2"))
    return pairs.join(texts, "id").join(other, "other").select("id", "content", "content2").mapInArrow(run, "id long")


def dedup_lines(docs: DataFrame, dropped: str | None = None) -> DataFrame:
    """docs with the text of each document's lines that repeat no earlier line; dropped names a count column."""
    spark = docs.sparkSession
    n = parallelism(spark)
    through = [c for c in docs.columns if c not in ("text", dropped)]
    keyed = _keyed(docs, through)
    at = scratch(spark, "lines")
    line_table(keyed).write.parquet(at)
    lines = spark.read.schema(LINES).parquet(at)
    place = F.struct(F.isnull("doc_id").alias("last"), "doc_id", "doc_key", "line")
    at = scratch(spark, "classes")
    lines.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n"), *(F.min(k).alias(k) for k in HALVES)).write.parquet(at)
    classes = spark.read.schema("h long, first struct<last: boolean, doc_id: long, doc_key: long, line: int>, n long, k1 long, k2 long, k3 long, k4 long").parquet(at)
    # ids of the candidates rise with their first places
    cand = classes.join(sharing_a_half(classes, n), "h", "left_semi").orderBy("first").select("h", F.col("first.doc_key").alias("doc_key"), F.col("first.line").alias("line"), F.monotonically_increasing_id().alias("id"))
    cand = cut(cand)
    texts = cut(candidate_texts(keyed, cand))
    near = cut(cand.join(verified(witnesses(texts, n), texts), "id", "left_semi").select("h", F.lit(True).alias("near")))
    # only lines of these classes can go; a table of its own, so that the join deals out a common line's rows
    fate = cut(classes.join(near, "h", "left").where("near or n > 1").select("h", "near", F.col("first.doc_key").alias("first_key"), F.col("first.line").alias("first_line")))
    gone = lines.select("h", "doc_key", "line").join(fate, "h").where(F.col("near").isNotNull() | (F.col("doc_key") != F.col("first_key")) | (F.col("line") != F.col("first_line")))
    # of repeated rows each has its lines listed
    gone = cut(gone.groupBy("doc_key").agg(F.collect_set("line").alias("gone")))
    out = _without(keyed.join(small(gone, "gone", NUMBER_BYTES), "doc_key", "left").select("row", "text", "gone"))
    own = dict(zip(through, unfolded(through), strict=True)) | {"text": F.col("text")} | ({dropped: F.col("dropped").alias(dropped)} if dropped else {})
    names = docs.columns + [c for c in (dropped,) if c and c not in docs.columns]
    return out.select(*map(own.__getitem__, names))


def _without(joined: DataFrame) -> DataFrame:
    """row, and the text without the lines listed in gone, and their number."""
    schema = T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), T.StructField("dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, texts, gone = batch.columns
            out, counts = [], []
            for t, g in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
                if g:
                    less = set(g)
                    t = "\n".join([x for k, x in enumerate(t.split("\n")) if k not in less])
                    t = t if t.strip() else ""
                out.append(t)
                counts.append(len(g or ()))
            yield pa.RecordBatch.from_arrays([row, pa.array(out, pa.string()), pa.array(counts, pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, number of lines kept and dropped, and the SHA-256 of the text that stays."""
    out = dedup_lines(docs.select("doc_id", "text"), "n_dropped")
    lines = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n", -1)))
    return out.select("doc_id", lines.cast("long").alias("n_kept"), "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))

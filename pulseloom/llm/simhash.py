"""Operator 3: SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 2-bit segments map to their bit counts, a vector whose Manhattan distance never exceeds
the Hamming distance of the fingerprints. The segments form BANDS bands. Two vectors within BITS of one
another differ in at most BITS bands, so they lie in the same grid cell of some BANDS - BITS bands; rows
meet by an equi-join on those cells. Within a cell the range of total bit counts comes first (it is a
Manhattan bound too), then the vectors' own Manhattan distance, and for those within BITS the Hamming
distance itself decides. Counts are kept in unary (0, 1 and 2 as 00, 01 and 11), where the Manhattan
distance of two vectors is the number of bits in which they differ. A cell gives a spanning forest of its
links, not all pairs; equal fingerprints meet as one class beforehand.

Defined results: null, empty and blank texts have fingerprint zero, which links like any other; rows with
a null doc_id get the component of their fingerprint's documents, or null where none has an id; other
columns pass through near_duplicates().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, carried, cut, keep_only, named, parallelism, pieces, unfolded
from .components import components

SEED, SHINGLE, BITS = 42, 4, 4
#: More bands make more cells a row and far fewer candidates: of 7 bands the fullest cell of random fingerprints holds
#: one in 13,000.
BANDS = 7
SEGMENTS = 32
#: Bytes of a broadcast id with its flags.
ID_BYTES = 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64, n)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", column: str = "fingerprint", drop_text: bool = False) -> DataFrame:
    """docs with a long column of fingerprints (as signed 64-bit integers)."""
    through = [c for c in docs.columns if c != column and not (drop_text and c == text)]
    given = docs.select(carried(through), named(text).alias("text"))
    schema = T.StructType([given.schema["row"], T.StructField("fingerprint", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("simhash")
        for whole in batches:
            for batch in pieces(whole):
                row, texts = batch.columns
                made = np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([row, pa.array(made)], names=schema.names)

    return given.mapInArrow(run, schema).select(*unfolded(through), F.col("fingerprint").alias(column))


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """The bit counts of each fingerprint's 2-bit segments, a row of SEGMENTS small integers each."""
    two = (fp.astype(np.uint64)[:, None] >> np.arange(0, 64, 2, dtype=np.uint64)) & np.uint64(3)
    return np.array([0, 1, 1, 2], np.uint8)[two]


def unary_counts(fp: np.ndarray) -> np.ndarray:
    """The segments' bit counts in unary, two bits each: differing bits of two such words are their Manhattan distance."""
    low, high = fp & np.uint64(0x5555555555555555), (fp >> np.uint64(1)) & np.uint64(0x5555555555555555)
    return (low | high) | (low & high) << np.uint64(1)


def cells(fp: np.ndarray, bits: int = BITS, bands: int = BANDS) -> Iterator[np.ndarray]:
    """For each choice of bands, the grid cell of each fingerprint as one number."""
    counts = segment_counts(fp).astype(np.int64)
    powers = np.int64(3) ** np.arange(SEGMENTS // bands + 1, dtype=np.int64)
    of = [counts[:, x[0] : x[-1] + 1] @ powers[: len(x)] for x in np.array_split(np.arange(SEGMENTS), bands)]
    for choice, chosen in enumerate(combinations(range(bands), bands - bits)):
        key = np.full(len(fp), choice, np.int64)
        for band in chosen:
            key = key * 3 ** (SEGMENTS // bands + 1) + of[band]
        yield key


def close_pairs(key: np.ndarray, fp: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of rows with the same key and at most bits differing bits; rows sorted by key and bit count."""
    ones, counts = np.bitwise_count(fp).astype(np.int64), unary_counts(fp)
    i, step = np.arange(len(fp) - 1), 1
    while len(i):
        j = i + step
        near = (j < len(fp)) & (key[i] == key[np.minimum(j, len(fp) - 1)]) & (ones[np.minimum(j, len(fp) - 1)] - ones[i] <= bits)
        i, j = i[near], j[near]
        within = np.bitwise_count(counts[i] ^ counts[j]) <= bits  # the lower bound
        a, b = i[within], j[within]
        hit = np.bitwise_count(fp[a] ^ fp[b]) <= bits
        if hit.any():
            yield a[hit], b[hit]
        step += 1


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(place, least place of its group) of the places that the pairs tie to a lower one."""
    label = np.arange(n)

    def settle(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(label, up := label[label]):
                label[:] = up

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for a, b in pairs:
        held.append((a, b))
        size += len(a)
        if size > 2_000_000:
            settle(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            held, size = [], 0
    if held:
        settle(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def links(classes: DataFrame, bits: int = BITS, bands: int = BANDS) -> DataFrame:
    """A spanning forest, cell by cell, of the links among classes (fp long, node long): columns a and b."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            ones = pa.array(np.bitwise_count(fp).astype(np.int32))
            for key in cells(fp, bits, bands):
                yield pa.RecordBatch.from_arrays([pa.array(key), ones, batch.column(0), batch.column(1)], names=["key", "ones", "fp", "node"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held = [none, none, none]

        def solve(rows: list[np.ndarray]) -> pa.RecordBatch:
            key, fp, node = rows
            at, root = forest(len(key), close_pairs(key, fp.view(np.uint64), bits))
            return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[root])], names=["a", "b"])

        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy()]) for h, i in zip(held, (0, 2, 3), strict=True)]
            if len(held[0]) and (whole := int(np.searchsorted(held[0], held[0][-1]))):  # the last cell may go on
                yield solve([h[:whole] for h in held])
                held = [h[whole:] for h in held]
        yield solve(held)

    n = parallelism(classes.sparkSession)
    met = classes.select("fp", "node").mapInArrow(emit, "key long, ones int, fp long, node long")
    return met.repartition(n, "key").sortWithinPartitions("key", "ones").mapInArrow(meet, "a long, b long").distinct()


def grouped(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """prints (with doc_id and fingerprint) and the component_id of each row."""
    classes = cut(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("node")))
    tied = components(links(classes.where("node is not null"), bits))
    named = classes.join(tied, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, prints["fingerprint"] == named["fp"], "left").drop("fp")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each document."""
    prints = cut(fingerprints(docs.select("doc_id", "text"), drop_text=True))
    return grouped(prints).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without those whose group has a smaller doc_id; of repeated rows one stays.

    Rows without a doc_id stay only where their whole group has none, one a fingerprint.
    """
    prints = cut(fingerprints(docs.select("doc_id", "text"), drop_text=True))
    ids = cut(grouped(prints).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__n"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("__kept")))
    # most documents stay, and once: only the others' ids meet the texts
    odd = cut(ids.where("not __kept or __n > 1"))
    odd = F.broadcast(odd) if odd.count() * ID_BYTES <= BROADCAST_BYTES else odd
    rows = docs.select(carried(docs.columns), "doc_id", "text")
    once = rows.where("doc_id is not null").join(odd, "doc_id", "left_anti").select("row")
    again = rows.join(odd.where("__kept"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("row")
    loose = fingerprints(rows.where("doc_id is null").select("row", "text"), drop_text=True).dropDuplicates(["fingerprint"])
    loose = loose.join(prints.where("doc_id is not null").select("fingerprint").distinct(), "fingerprint", "left_anti").select("row")
    return once.unionByName(again).unionByName(loose).select(*unfolded(docs.columns))

"""Operator 11: how the sources of a language diverge from one another and from the language as a whole.

Documents are counted where they lie, by (lang, source, term), and summed by a shuffle on all three. Every share is an
integer out of a thousand million, by long division in three steps of a thousand, so that no product leaves 64 bits.

Pairs of sources are sums over the terms that a source has, corrected for the baseline that every other kept term
gives: f(p, q) summed over all terms is V f(b, c) + sum over one's terms of f(p, c) - f(b, c) + sum over the other's of
f(b, q) - f(b, c) + sum over common terms of f(p, q) - f(p, c) - f(b, q) + f(b, c), with b and c the shares of a
term that does not occur. Terms are dealt to slices and sources to blocks of BLOCK, so that a task holds a slice's
entries of two blocks, whatever the number of sources; a term that all sources have is no group of its own.

Terms are ranked by radix selection: histograms of the values' bits, SPREAD at a time, find each group's k-th value;
of the rows that tie there, histograms of the next two UTF-8 bytes behind what all of them share find the last item
taken. Where at most FINISH rows are open in a group they are ranked outright. At most k rows a group are sorted.

Defined results: null text, lang and source read as ''; a group without terms has baseline shares; a language that
keeps no term has pairs of value 0; rows count as documents, whatever their doc_id; an empty table gives no rows; other
columns, whatever their names, are left out. Ranks of pairs are numbered in windows of a source's pairs, as many rows as
its language has sources.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, keep_only, scratch

LEAST_DOCS, TOP = 10, 10
PARTS = 1_000_000_000
#: Sources of a block, entries of a slice, distinct terms that a task gathers before it passes them on.
BLOCK, SLICE, GATHERED = 256, 10_000, 300_000
#: Bits of a value that a histogram takes, of all that values have, and rows of a group that are ranked outright.
SPREAD, BITS, FINISH = 10, 30, 4096
#: ASCII letters in lower case, all bytes beyond ASCII as they are, a space for any other.
_terms = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame, gathered: int = GATHERED) -> DataFrame:
    """lang, source, term, n and docs: occurrences, and rows with the term; a row without a term counts the group's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("divergence")
        total: dict[tuple[str, str], Counter] = {}
        found: dict[tuple[str, str], Counter] = {}
        rows: Counter = Counter()
        held = 0

        def some() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in total.items():
                terms, df = list(own), found[lang, source]
                for i in range(0, len(terms) + 1, 50_000):
                    part = terms[i : i + 50_000]
                    last = i + 50_000 > len(terms)  # with it, the group's own row
                    n = np.array([*map(own.__getitem__, part), *[0] * last], np.int64)
                    d = np.array([*map(df.__getitem__, part), *[rows[lang, source]] * last], np.int64)
                    term = pa.array([*part, *[None] * last], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array([source] * len(n)), term, pa.array(n), pa.array(d)], names=["lang", "source", "term", "n", "docs"])
            total.clear()
            found.clear()
            rows.clear()

        for batch in batches:
            for lang, source, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                key = lang, source
                if key not in total:
                    total[key], found[key] = Counter(), Counter()
                words = t.translate(_terms).split()
                held -= len(total[key])
                total[key].update(words)
                found[key].update(set(words))
                rows[key] += 1
                held += len(total[key]) + 1
                if held > gathered:
                    yield from some()
                    held = 0
        yield from some()

    text, lang, source = (F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    counted = docs.select(lang, source, text).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(PARTS * (count + 2) / whole), exactly, for wholes up to 2^53."""
    q, r = np.divmod(count + 2, whole)
    for _ in range(3):
        d, r = np.divmod(r * 1000, whole)
        q = q * 1000 + d
    return q + 1


def share_of(df: DataFrame, count: Column, whole: Column, name: str) -> DataFrame:
    """df with share() of two columns."""
    df = df.withColumns({"__r": count + 2, "__whole": whole}).withColumns({"__q": F.expr("__r div __whole"), "__r": F.expr("__r % __whole")})
    for _ in range(3):
        df = df.withColumn("__r", F.col("__r") * 1000).withColumns({"__q": F.col("__q") * 1000 + F.expr("__r div __whole"), "__r": F.expr("__r % __whole")})
    return df.withColumn(name, F.col("__q") + 1).drop("__q", "__r", "__whole")


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def slice_sums(table: pa.Table) -> pa.Table:
    """Partial sums of the pairs of sources of two blocks over a slice's terms.

    table has a row (term null) for each source of the blocks, with whole and V, and one for each entry.
    """
    lang, piece, bi, bj = (table.column(c)[0].as_py() for c in ("lang", "slice", "bi", "bj"))
    own = pc.is_null(table.column("term"))
    groups, entries = table.filter(own), table.filter(pc.invert(own))
    names = groups.column("source").combine_chunks()
    whole, block = groups.column("whole").to_numpy(), groups.column("block").to_numpy()
    kept = groups.column("kept").to_numpy()
    s = len(names)
    sums = np.zeros((s, s), np.int64)
    if kept[0] > 0:
        base = share(np.zeros(s, np.int64), whole)
        flat = gap(base[:, None], base[None, :])
        if piece == 0:
            sums += kept[0] * flat
        g = pc.index_in(entries.column("source"), value_set=names).to_numpy().astype(np.int64)
        term = entries.column("term").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        order = np.lexsort((g, term))
        g, term = g[order], term[order]
        p = share(entries.column("n").to_numpy()[order], whole[g])
        one = np.zeros((s, s), np.int64)
        for i in range(s):
            shares, times = np.unique(p[g == i], return_counts=True)
            for at in range(0, len(shares), 4096):
                some = gap(shares[at : at + 4096, None], base[None, :]) - flat[i]
                one[i] += (some * times[at : at + 4096, None]).sum(axis=0)
        sums += one + one.T
        at, d = np.arange(len(g)), 1
        while len(at := at[at + d < len(g)]) and len(at := at[term[at] == term[at + d]]):
            i, j, x, y = g[at], g[at + d], p[at], p[at + d]
            more = gap(x, y) - gap(x, base[j]) - gap(base[i], y) + flat[i, j]
            np.add.at(sums, (i, j), more)
            np.add.at(sums, (j, i), more)
            d += 1
    left, right = np.nonzero((block[:, None] == bi) & (block[None, :] == bj) & ((sums != 0) | (piece == 0)))
    if bi == bj:
        left, right = left[left < right], right[left < right]
    n = len(left)
    return pa.table({"lang": pa.array([lang] * n, pa.string()), "one": names.take(pa.array(left)), "other": names.take(pa.array(right)), "value": pa.array(sums[left, right])})


def pair_values(entries: DataFrame, groups: DataFrame, langs: DataFrame, block: int = BLOCK, slice_rows: int = SLICE) -> DataFrame:
    """lang, source, item and value: each pair of sources of a language, either way round.

    entries is (lang, source, term, n), groups (lang, source, whole), langs (lang, sources, entries, kept).
    """
    per_slice = F.greatest(F.lit(slice_rows), F.pow(F.least("sources", F.lit(block)), F.lit(2)).cast("long"))
    dealt = langs.withColumn("blocks", F.ceil(F.col("sources") / block).cast("int"))
    dealt = dealt.withColumn("slices", F.greatest(F.lit(1), F.ceil(F.col("entries") / (per_slice * F.greatest(F.lit(1.0), F.col("blocks") / 2)))).cast("int")).select("lang", "kept", "blocks", "slices")
    place = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")

    def met(rows: DataFrame, piece: Column) -> DataFrame:
        """rows, once for each block that theirs is held against."""
        d = rows.withColumns({"block": place, "slice": piece}).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        d = d.withColumns({"bi": F.least("block", "x"), "bj": F.greatest("block", "x")})
        return d.select("lang", "slice", "bi", "bj", "block", "source", "term", "n", "whole", "kept")

    none = F.lit(None)
    e = met(entries.join(dealt, "lang").withColumn("whole", none.cast("long")), F.pmod(F.xxhash64("term"), F.col("slices")).cast("int"))
    g = met(groups.join(dealt, "lang").select("*", none.cast("string").alias("term"), none.cast("long").alias("n")), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    sums = e.unionByName(g).groupBy("lang", "slice", "bi", "bj").applyInArrow(slice_sums, "lang string, one string, other string, value long")
    sums = sums.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item"))))
    return sums.select("lang", "value", ways.alias("way")).select("lang", "way.source", "way.item", "value")


def radix_top(rows: DataFrame, keys: list[str], value: str, item: str, k: int, bits: int = BITS, spread: int = SPREAD, finish: int = FINISH) -> DataFrame:
    """rows of the k highest values of each group of keys, ties to lesser items, with rank. Items differ within a group.

    rows is read several times, so it should be a written table; values lie from 0 to 2^bits - 1.
    """
    group = Window.partitionBy(*keys)
    at = rows.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("prefix"), F.lit(k).cast("long").alias("need"))
    shift = -(-bits // spread) * spread
    while shift:
        shift -= spread
        # a row for each group and value of so many bits
        open_rows = rows.join(at, keys).where(F.shiftright(value, shift + spread) == F.col("prefix")) if shift + spread < 63 else rows.join(at, keys)
        seen = open_rows.groupBy(*keys, "need", F.shiftright(value, shift).alias("digit")).agg(F.count("*").alias("n"))
        seen = seen.withColumns({"upto": F.sum("n").over(group.orderBy(F.desc("digit"))), "least": F.min("digit").over(group)})
        # the first digit that reaches the need, or the last one where a group has fewer rows
        hit = (F.col("upto") - F.col("n") < F.col("need")) & ((F.col("upto") >= F.col("need")) | (F.col("digit") == F.col("least")))
        at = cut(seen.where(hit).select(*keys, F.col("digit").alias("prefix"), (F.col("need") - F.col("upto") + F.col("n")).alias("need")))
    path = scratch(rows.sparkSession, "radix-ties")
    rows.join(at, keys).where(F.col(value) == F.col("prefix")).select(*keys, "need", F.encode(item, "UTF-8").alias("raw")).write.parquet(path)
    ties = rows.sparkSession.read.parquet(path)
    still = ties.drop("need").join(at.select(*keys, "need"), keys)
    found = None
    while True:
        state = cut(still.groupBy(*keys, "need").agg(F.count("*").alias("n"), F.min("raw").alias("low"), F.max("raw").alias("high")))
        done = state.where("n <= need").select(*keys, F.col("high").alias("last"))
        few = still.join(state.where(f"n > need and n <= {finish}").select(*keys), keys)
        few = few.withColumn("nth", F.row_number().over(group.orderBy("raw"))).where("nth = need").select(*keys, F.col("raw").alias("last"))
        done = done.unionByName(few)
        found = done if found is None else found.unionByName(done)
        many = state.where(f"n > need and n > {finish}")
        if many.isEmpty():
            break
        # what low and high share is shared by all between them
        shared = F.expr("aggregate(sequence(1, greatest(1, least(length(low), length(high)))), 0, (a, i) -> if(a = i - 1 and length(low) >= i and length(high) >= i and substring(low, i, 1) = substring(high, i, 1), i, a))")
        wide = still.drop("need").join(many.select(*keys, "need", shared.alias("shared")), keys).withColumn("digit", F.expr("substring(raw, 1, shared + 2)"))
        seen = wide.groupBy(*keys, "need", "shared", "digit").agg(F.count("*").alias("n"))
        seen = seen.withColumn("upto", F.sum("n").over(group.orderBy("digit")))
        pick = cut(seen.where("upto - n < need and upto >= need").select(*keys, F.col("digit").alias("pick"), "shared", (F.col("need") - F.col("upto") + F.col("n")).alias("need")))
        still = ties.drop("need").join(pick, keys).where("substring(raw, 1, shared + 2) = pick").select(*keys, "need", "raw")
    top = rows.join(at.select(*keys, F.col("prefix").alias("__kth")), keys).join(found, keys)
    top = top.where((F.col(value) > F.col("__kth")) | ((F.col(value) == F.col("__kth")) & (F.encode(item, "UTF-8") <= F.col("last")))).drop("__kth", "last")
    return top.withColumn("rank", F.row_number().over(group.orderBy(F.desc(value), item)).cast("int"))


def divergence_report(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, slice_rows: int = SLICE, finish: int = FINISH) -> DataFrame:
    """lang, source, part, item, value and rank: pairs of sources of a language, and each group's most unusual terms."""
    spark = docs.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, f"divergence-{name}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    counts = written(term_counts(docs), "counts")
    kept = written(counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs).drop("docs"), "terms")
    entries = written(counts.where("term is not null").drop("docs").join(kept, ["lang", "term"]), "entries")
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("entries"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0)
    groups = written(groups.withColumns({"whole": F.col("total") + 2 * F.col("kept"), "lang_whole": F.col("lang_total") + 2 * F.col("kept")}), "groups")
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("entries").alias("entries"), F.max("kept").alias("kept"))

    pairs = pair_values(entries.select("lang", "source", "term", "n"), groups.select("lang", "source", "whole"), langs, block, slice_rows)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int"))

    shares = entries.join(groups.select("lang", "source", "whole", "lang_whole"), ["lang", "source"])
    shares = share_of(share_of(shares, F.col("n"), F.col("whole"), "p"), F.col("lang_n"), F.col("lang_whole"), "q").where("p > q")
    unusual = written(shares.select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value")), "unusual")
    terms = radix_top(unusual, ["lang", "source"], "value", "item", top, finish=finish)
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*out).unionByName(terms.withColumn("part", F.lit("term")).select(*out))


ORACLE_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT lang, source, r, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM kept GROUP BY lang),
e AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY w.lang, w.source, w.term),
g AS (SELECT DISTINCT d.lang, d.source FROM d),
gt AS (SELECT g.lang, g.source, coalesce(sum(e.n), 0)::HUGEINT AS total FROM g LEFT JOIN e ON e.lang = g.lang AND e.source = g.source GROUP BY g.lang, g.source),
p AS (
  SELECT gt.lang, gt.source, k.term, coalesce(e.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(e.n, 0) + 2)) // (gt.total + 2 * v.v) AS p,
    1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (v.lang_total + 2 * v.v) AS q
  FROM gt JOIN kept k ON k.lang = gt.lang JOIN v ON v.lang = gt.lang LEFT JOIN e ON e.lang = gt.lang AND e.source = gt.source AND e.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""

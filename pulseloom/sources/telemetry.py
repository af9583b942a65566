"""Telemetry sources: multiplexed text lines, and binary packets of bit-packed samples.

Lines are parsed by built-in string functions, so the same code serves files and streams. Packets decode in an
Arrow map, all of one layout at once; the bit layout is a fixed format. Packets that only say how far they lie
behind the one before are placed by running sums over a device's packets, and status text that comes in
fragments is put together by line: no state is kept in Python. What cannot be decoded is an error row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PPG = ["sample_seq", "timestamp_ms", "red", "ir"]
IMU = ["imu_seq", "timestamp_ms", "x_raw", "y_raw", "z_raw"]

# Fixed values of the packet format: frame families, widths in bits, the least step of time in ms.
PPG_ABSOLUTE, IMU_ABSOLUTE, PPG_BATCH, IMU_BATCH = 0x81, 0x82, 0xB0, 0xC0
PPG_DELTA, IMU_DELTA, STATUS, STATUS_FRAGMENT = 0x90, 0xA0, 0x80, 0xD0
LONGEST_LINE = 4096
PPG_BITS, IMU_BITS, STEP_BITS, STEP_MS = 18, 11, 3, 8


def read_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Lines of text files with the recording they come from, as a table or a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.text(path).select(F.col("_metadata.file_name").alias("recording"), F.col("value").alias("line"))


def _whole(part, low: int, high: int):
    n = F.when(part.rlike(r"^\s*-?[0-9]{1,18}\s*$"), F.trim(part).try_cast("long"))
    return F.when(n.between(low, high), n)


def with_kind(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with kind (ppg, imu, status, noise) and the fields of each; malformed rows are noise."""
    t = F.trim(line)
    p = F.split(t, ",")
    at = lambda i: F.get(p, F.lit(i))
    top = 2**62
    ppg = F.struct(_whole(at(0), 0, top).alias("sample_seq"), _whole(at(1), 0, top).alias("timestamp_ms"), _whole(at(2), 0, 2**31 - 1).cast("int").alias("red"), _whole(at(3), 0, 2**31 - 1).cast("int").alias("ir"))
    axis = lambda i: _whole(at(i), -(2**15), 2**15 - 1).cast("short")
    imu = F.struct(_whole(at(1), 0, top).alias("imu_seq"), _whole(at(2), 0, top).alias("timestamp_ms"), axis(3).alias("x_raw"), axis(4).alias("y_raw"), axis(5).alias("z_raw"))
    whole = lambda s, names: F.aggregate(F.array(*[s[n].isNotNull() for n in names]), F.lit(True), lambda a, x: a & x)
    is_ppg = (F.size(p) == 4) & whole(ppg, PPG)
    is_imu = (F.size(p) == 6) & (at(0) == "imu") & whole(imu, IMU)
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(t, "^#", ""), ",", " "), r"\s+"), lambda x: x != "")
    pairs = F.transform(F.filter(words, lambda x: x.contains("=")), lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.regexp_replace(x, "^[^=]*=", "").alias("value")))
    fields = F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda e: e["key"])), lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda e: e["key"] == k), -1)["value"])))
    status = F.struct(F.get(words, F.lit(0)).alias("type"), fields.alias("fields"))
    is_status = t.startswith("#") & (F.size(words) > 0)
    kind = F.when(is_status, "status").when(is_imu, "imu").when(is_ppg, "ppg").otherwise("noise")
    return lines.withColumn("kind", kind).withColumns({"ppg": F.when(F.col("kind") == "ppg", ppg), "imu": F.when(F.col("kind") == "imu", imu), "status": F.when(F.col("kind") == "status", status)})


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


class Bits:
    """Whole numbers of given widths, least significant bit first."""

    def __init__(self, data: bytes = b""):
        self.value, self.at = int.from_bytes(data, "little"), 0

    def take(self, width: int, signed: bool = False) -> int:
        v = self.value >> self.at & ((1 << width) - 1)
        self.at += width
        return v - (1 << width) if signed and v >> (width - 1) else v

    def put(self, v: int, width: int) -> None:
        self.value |= (v & ((1 << width) - 1)) << self.at
        self.at += width


def batch_packet(family: int, seq: int, ms: int, samples: list[tuple]) -> bytes:
    """A self-contained packet: the first sample's place, then samples, all but the first with their step of time."""
    bits = Bits()
    width = PPG_BITS if family == PPG_BATCH else IMU_BITS
    before = ms
    for i, (t, *values) in enumerate(samples):
        for v in values:
            bits.put(v, width)
        if i:
            bits.put(t - before - STEP_MS, STEP_BITS)
        before = t
    return bytes([family | len(samples)]) + struct.pack("<II", seq, ms) + bits.value.to_bytes((bits.at + 7) // 8, "little")


def delta_packet(family: int, before: int, samples: list[tuple]) -> bytes:
    """A packet of samples that follow the device's last one, which was at before."""
    bits = Bits()
    for t, *values in samples:
        for v in values:
            bits.put(v, PPG_BITS if family == PPG_DELTA else IMU_BITS)
        bits.put(t - before - STEP_MS, STEP_BITS)
        before = t
    return bytes([family | len(samples)]) + bits.value.to_bytes((bits.at + 7) // 8, "little")


def _layout(first: int, size: int) -> tuple | str | None:
    """(kind, samples, values, bits of each, first bit, placed) of a frame byte and a length; a fault, or None for other frames."""
    if first in (PPG_ABSOLUTE, IMU_ABSOLUTE):
        ppg = first == PPG_ABSOLUTE
        return ("ppg", 1, 2, 32, 72, True) if ppg and size == 17 else ("imu", 1, 3, 16, 72, True) if not ppg and size == 15 else "absolute packet of a wrong length"
    family, count = first & 0xF0, first & 0x0F
    if family not in (PPG_BATCH, IMU_BATCH, PPG_DELTA, IMU_DELTA):
        return None
    ppg, placed = family in (PPG_BATCH, PPG_DELTA), family in (PPG_BATCH, IMU_BATCH)
    if not count:
        return "batch without samples"
    values, width, head = (2, PPG_BITS, 72) if ppg else (3, IMU_BITS, 72)
    head = head if placed else 8
    if size != (head + count * values * width + (count - placed) * STEP_BITS + 7) // 8:
        return "batch of a wrong length"
    return ("ppg" if ppg else "imu", count, values, width, head, placed)


def _unpacked(raw: np.ndarray, layout: tuple) -> dict[str, np.ndarray]:
    """The samples of packets of one layout (a row of bytes each), sample by sample of each packet."""
    kind, count, values, width, head, placed = layout
    bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.int64)
    number = lambda at, n: bits[:, at : at + n] @ (1 << np.arange(n, dtype=np.int64))
    out = {k: np.zeros((len(raw), count), np.int64) for k in ("seq", "ms", "step", "a", "b", "c")}
    at = head
    for i in range(count):
        for v in range(values):
            x = number(at, width)
            out["abc"[v]][:, i] = np.where(x >> (width - 1), x - (1 << width), x) if kind == "imu" else x
            at += width
        if i or not placed:
            out["step"][:, i] = STEP_MS + number(at, STEP_BITS)
            at += STEP_BITS
    if placed:
        out["seq"] += number(8, 32)[:, None] + np.arange(count)
        out["ms"] += number(40, 32)[:, None] + np.cumsum(out["step"], axis=1)
    return out


SAMPLES = "kind string, nth int, seq long, timestamp_ms long, step_ms long, a long, b long, c long, text binary, error string"


def packet_samples(df: DataFrame, packet: str = "packet") -> DataFrame:
    """A row for each sample, status text or fault of the packets of df, with df's other columns; relative samples have no seq."""
    through = [c for c in df.columns if c != packet]
    schema = T.StructType([*(df.schema[c] for c in through), *T.StructType.fromDDL(SAMPLES)])
    kinds = [pa.string(), pa.int32(), *[pa.int64()] * 6, pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packets = batch.column(len(through)).to_pylist()
            same: dict[tuple, list[int]] = {}
            whole: list[tuple] = []  # (place, row) of what is no sample
            for i, p in enumerate(packets):
                if not p:
                    whole.append((i, ("error", None, "empty packet")))
                    continue
                got = _layout(p[0], len(p))
                if isinstance(got, tuple):
                    same.setdefault((got, len(p)), []).append(i)
                elif isinstance(got, str):
                    whole.append((i, ("error", None, got)))
                elif p[0] == STATUS_FRAGMENT and len(p) < 4:
                    whole.append((i, ("error", None, "status fragment of a wrong length")))
                elif p[0] in (STATUS, STATUS_FRAGMENT):
                    whole.append((i, ("status" if p[0] == STATUS else "fragment", p[1:], None)))
                else:
                    whole.append((i, ("text", p, None)))
            place, cols = [], [[] for _ in kinds]
            for (layout, size), at in same.items():
                x = _unpacked(np.frombuffer(b"".join(packets[i] for i in at), np.uint8).reshape(-1, size), layout)
                n = x["seq"].size
                place.append(np.repeat(at, layout[1]))
                placed = np.full(n, not layout[5])
                for c, v in zip(cols, ([layout[0]] * n, np.tile(np.arange(layout[1], dtype=np.int32), len(at)), x["seq"].ravel(), x["ms"].ravel(), x["step"].ravel(), x["a"].ravel(), x["b"].ravel(), x["c"].ravel(), [None] * n, [None] * n), strict=True):
                    c.append(v)
                for k in (2, 3):
                    cols[k][-1] = pa.array(cols[k][-1], mask=placed)
                if layout[2] == 2:
                    cols[7][-1] = pa.nulls(n, pa.int64())
            if whole:
                n = len(whole)
                place.append(np.array([i for i, _ in whole]))
                for c, v in zip(cols, ([r[0] for _, r in whole], [0] * n, *[[None] * n] * 6, [r[1] for _, r in whole], [r[2] for _, r in whole]), strict=True):
                    c.append(v)
            if place:
                at = pa.array(np.concatenate(place).astype(np.int64))
                made = [pa.concat_arrays([pa.array(v, k) if not isinstance(v, pa.Array) else v for v in c]) for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in range(len(through))] + made, names=schema.names)

    return df.select(*through, packet).mapInArrow(run, schema)


def decode_packets(df: DataFrame, packet: str = "packet") -> DataFrame:
    """A row for each sample of the self-contained packets of df, with df's other columns; others are error rows."""
    s = packet_samples(df, packet)
    sample = F.col("seq").isNotNull()
    why = F.when(~sample, F.coalesce("error", F.concat(F.lit("no place of its own: "), F.col("kind"))))
    own = [c for c in df.columns if c != packet]
    return s.select(*own, F.when(sample, F.col("kind")).otherwise("error").alias("kind"), "seq", "timestamp_ms", *[F.col(c).cast("int").alias(c) for c in "abc"], why.alias("error"))


def placed_samples(df: DataFrame, keys: list[str], order: str, packet: str = "packet") -> DataFrame:
    """The samples of each device's packets in order, relative ones placed behind the last that has a place of its own.

    A running count and sum since that one, per device and kind; a relative sample before any is an error row.
    """
    s = packet_samples(df, packet).where("kind in ('ppg', 'imu', 'error')")
    w = Window.partitionBy(*keys, "kind").orderBy(order, "nth")
    s = s.withColumn("__from", F.count("seq").over(w))
    since = Window.partitionBy(*keys, "kind", "__from").orderBy(order, "nth")
    at = F.col("__from") > 0
    seq = F.when(at, F.first("seq").over(since) + F.row_number().over(since) - 1)
    ms = F.when(at, F.first("timestamp_ms").over(since) + F.sum(F.when(F.col("seq").isNull(), F.col("step_ms")).otherwise(0)).over(since))
    why = F.when((F.col("kind") != "error") & ~at, "batch before an absolute sample").otherwise(F.col("error"))
    return s.select(*keys, order, F.when(why.isNull(), F.col("kind")).otherwise("error").alias("kind"), seq.alias("seq"), ms.alias("timestamp_ms"), "a", "b", "c", why.alias("error"))


def status_lines(df: DataFrame, keys: list[str], order: str, packet: str = "packet") -> DataFrame:
    """The status lines of each device: whole ones, and those put together from numbered fragments.

    A fragment that does not follow its predecessor begins anew, and what was open is lost, as is an end
    without a line break; a line of over LONGEST_LINE bytes is an error row.
    """
    s = packet_samples(df, packet).where("kind in ('status', 'fragment')")
    whole = s.where("kind = 'status'").select(*keys, order, F.regexp_replace(F.decode("text", "UTF-8"), r"\s+$", "").alias("line"), F.lit(None).cast("string").alias("error"))
    f = s.where("kind = 'fragment'").withColumn("number", F.conv(F.hex(F.substring("text", 2, 1)), 16, 10).cast("int") * 256 + F.conv(F.hex(F.substring("text", 1, 1)), 16, 10).cast("int"))
    w = Window.partitionBy(*keys).orderBy(order)
    f = f.withColumn("__new", F.when(F.col("number") == F.pmod(F.lag("number").over(w) + 1, F.lit(65536)), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
    # pieces between line breaks: all but the first of a fragment begin a line
    f = f.select(*keys, order, "__run", F.posexplode(F.split(F.decode(F.expr("substring(text, 3)"), "UTF-8"), "\n", -1)).alias("__piece", "__part"))
    f = f.withColumn("__line", F.sum(F.when(F.col("__piece") > 0, 1).otherwise(0)).over(Window.partitionBy(*keys, "__run").orderBy(order, "__piece")))
    last = F.max("__line").over(Window.partitionBy(*keys, "__run"))
    f = f.withColumn("__open", F.col("__line") == last).where("not __open")
    g = f.groupBy(*keys, "__run", "__line").agg(F.max(order).alias(order), F.sum(F.octet_length("__part")).alias("__n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "__piece", "__part"))), lambda x: x["__part"]), "").alias("line"))
    long = F.col("__n") > LONGEST_LINE
    return whole.unionByName(g.select(*keys, order, F.when(~long, F.regexp_replace("line", r"\s+$", "")).alias("line"), F.when(long, "status line beyond the safe length").alias("error")))

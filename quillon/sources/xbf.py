"""Typed binary snapshots (XBF 1.x): reader, Spark data source, writer, and a report of what a DBF can't hold."""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import QueryError
from .files import append_file, create_bytes, open_bytes, read_range, remove_folder, size_of

# Type tags of the format.
BOOLEAN, INT32, INT64, UINT64, FLOAT32, FLOAT64, STRING, BYTES, DATE, TIMESTAMP, UUID, JSON = 0x01, 0x10, 0x11, 0x12, 0x20, 0x21, 0x30, 0x31, 0x40, 0x41, 0x60, 0x70
HEADER = 100
MAGIC = b"TXBF"

SPARK = {
    BOOLEAN: T.BooleanType(), INT32: T.IntegerType(), INT64: T.LongType(), UINT64: T.DecimalType(20, 0), FLOAT32: T.FloatType(), FLOAT64: T.DoubleType(), STRING: T.StringType(),
    BYTES: T.BinaryType(), DATE: T.DateType(), TIMESTAMP: T.TimestampNTZType(), UUID: T.StringType(), JSON: T.StringType(),
}


def crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


_CRC = crc_table()


def _bytewise(raw: bytes, c: int) -> int:
    for b in raw:
        c = c >> 8 ^ _CRC[(c ^ b) & 255]
    return c


LANES = 1024  # pieces of a large input whose checksums are made side by side


def crc32c(raw: bytes, before: int = 0) -> int:
    """CRC-32C of raw, or of what gave `before` followed by raw. Large inputs are cut into lanes, done as vectors and joined."""
    if len(raw) < 64 * LANES:
        return _bytewise(raw, before ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    import numpy as np

    width = len(raw) // LANES
    rows = np.ascontiguousarray(np.frombuffer(raw, np.uint8, width * LANES).reshape(LANES, width).T)
    table, c = np.array(_CRC, np.uint32), np.full(LANES, 0xFFFFFFFF, np.uint32)
    for row in rows:
        c = (c >> np.uint32(8)) ^ table[(c ^ row) & np.uint32(255)]
    out = before
    for x in (c ^ np.uint32(0xFFFFFFFF)).tolist():
        out = crc32c_joined(out, x, width)
    return crc32c(raw[width * LANES :], out)


@lru_cache(maxsize=64)
def _zeros(size: int) -> tuple[int, ...]:
    """What `size` zero bytes do to each bit of a running checksum: a 32 x 32 matrix over two elements, by squaring."""
    times = lambda m, v: reduce(lambda a, i: a ^ (m[i] if v >> i & 1 else 0), range(32), 0)
    step, out = tuple(_bytewise(b"\0", 1 << i) for i in range(32)), tuple(1 << i for i in range(32))
    while size:
        if size & 1:
            out = tuple(times(step, v) for v in out)
        step, size = tuple(times(step, v) for v in step), size >> 1
    return out


def crc32c_joined(a: int, b: int, size: int) -> int:
    """CRC-32C of two pieces from theirs; size: bytes of the second."""
    m = _zeros(size)
    return reduce(lambda x, i: x ^ (m[i] if a >> i & 1 else 0), range(32), 0) ^ b


@dataclass(frozen=True)
class XField:
    name: str
    tag: int
    flags: int = 1  # 1 nullable, 2 primary, 4 unique


@dataclass(frozen=True)
class Layout:
    fields: tuple[XField, ...]
    directory: int
    data: int
    data_length: int
    data_crc: int
    count: int
    generation: int


def read_layout(path: str) -> Layout:
    head = read_range(path, 0, HEADER)
    if len(head) < HEADER or head[:4] != MAGIC:
        raise QueryError("not an XBF file")
    major, minor, flags, length = struct.unpack_from("<HHII", head, 4)
    if major != 1 or flags or (minor == 0 and length != HEADER) or length < HEADER or (length - HEADER) % 28:
        raise QueryError("an XBF version or flag that isn't known")
    whole = read_range(path, 0, length)
    if crc32c(whole[:92] + bytes(4) + whole[96:]) != struct.unpack_from("<I", head, 92)[0]:
        raise QueryError("the XBF header is damaged")
    s_at, s_len, s_crc = struct.unpack_from("<QQI", head, 16)
    d_at, d_len, d_crc = struct.unpack_from("<QQI", head, 36)
    v_at, v_len, v_crc = struct.unpack_from("<QQI", head, 56)
    count, generation = struct.unpack_from("<QQ", head, 76)
    if max(s_at + s_len, d_at + d_len, v_at + v_len) > size_of(path) or d_len != 24 * count:
        raise QueryError("the XBF sections lie outside the file")
    schema = read_range(path, s_at, s_len)
    if crc32c(schema) != s_crc:
        raise QueryError("the XBF schema is damaged")
    if crc32c(read_range(path, d_at, d_len)) != d_crc:
        raise QueryError("the XBF directory is damaged")
    fields, at = [], 4
    for _ in range(struct.unpack_from("<I", schema)[0]):
        n = struct.unpack_from("<H", schema, at)[0]
        name = schema[at + 2 : at + 2 + n].decode()
        tag, bits, zero = struct.unpack_from("<BBH", schema, at + 2 + n)
        if tag not in SPARK or bits & ~7 or zero or not 1 <= n <= 255:
            raise QueryError(f"an XBF field that isn't valid: {name}")
        fields.append(XField(name, tag, bits))
        at += 6 + n
    if at != len(schema) or len({f.name for f in fields}) != len(fields):
        raise QueryError("the XBF schema isn't valid")
    return Layout(tuple(fields), d_at, v_at, v_len, v_crc, count, generation)


def decode_value(tag: int, own: int, raw: bytes):
    if own == 0:
        if raw:
            raise QueryError("an XBF null with a payload")
        return None
    if own != tag and not (tag in (INT64, UINT64) and own in (INT32, INT64)):
        raise QueryError("an XBF value of another type than its field")
    if own == BOOLEAN:
        return raw == b"\1"
    if own in (INT32, DATE):
        x = struct.unpack("<i", raw)[0]
        return date(1970, 1, 1) + timedelta(days=x) if own == DATE else x
    if own in (INT64, TIMESTAMP):
        x = struct.unpack("<q", raw)[0]
        return datetime(1970, 1, 1) + timedelta(milliseconds=x) if own == TIMESTAMP else x
    if own == UINT64:
        from decimal import Decimal

        return Decimal(struct.unpack("<Q", raw)[0])
    if own == FLOAT32:
        return struct.unpack("<f", raw)[0]
    if own == FLOAT64:
        return struct.unpack("<d", raw)[0]
    if own == BYTES:
        return raw
    return str(uuid.UUID(bytes=raw)) if own == UUID else raw.decode()


def decode_record(fields, raw: bytes) -> list:
    out, at = [], 0
    for f in fields:
        if at + 5 > len(raw):
            raise QueryError("an XBF record is truncated")
        own, size = struct.unpack_from("<BI", raw, at)
        out.append(decode_value(f.tag, own, raw[at + 5 : at + 5 + size]))
        at += 5 + size
    if at != len(raw):
        raise QueryError("an XBF record has trailing bytes")
    return out


def widened(x, tag: int):
    from decimal import Decimal

    return Decimal(x) if tag == UINT64 and isinstance(x, int) else x


class XbfSource(DataSource):
    """spark.read.format("xbf").load(path); options: rows (records of a task), verify (whether the data's checksum is tested)."""

    @classmethod
    def name(cls) -> str:
        return "xbf"

    def schema(self):
        out = T.StructType()
        for f in read_layout(self.options["path"]).fields:
            out.add(T.StructField(f.name, SPARK[f.tag], True, {"xbf_tag": f.tag, "xbf_flags": f.flags}))
        return out.add("_record_number", T.LongType()).add("_deleted", T.BooleanType())

    def reader(self, schema):
        return XbfReader(self.options)


@dataclass
class Entries(InputPartition):
    first: int
    count: int


class XbfReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rows = options["path"], int(options.get("rows", 100_000))
        self.layout = read_layout(self.path)
        if options.get("verify", "true") == "true" and self.checksum() != self.layout.data_crc:
            raise QueryError("the XBF data is damaged")

    def checksum(self, piece: int = 16 << 20) -> int:
        out, left, at = 0, self.layout.data_length, self.layout.data
        while left > 0:
            raw = read_range(self.path, at, min(piece, left))
            if not raw:
                break
            out, left, at = crc32c(raw, out), left - len(raw), at + len(raw)
        return out

    def partitions(self):
        n = self.layout.count
        return [Entries(i, min(self.rows, n - i)) for i in range(0, n, self.rows)] or [Entries(0, 0)]

    def read(self, partition):
        h = self.layout
        entries = list(struct.iter_unpack("<QQII", read_range(self.path, h.directory + 24 * partition.first, 24 * partition.count)))
        if not entries:
            return
        low, high = min(e[0] for e in entries), max(e[0] + e[1] for e in entries)
        if low < h.data or high > h.data + h.data_length:
            raise QueryError("an XBF record lies outside the data")
        raw = read_range(self.path, low, high - low)
        for i, (at, size, flags, zero) in enumerate(entries):
            if flags & ~1 or zero:
                raise QueryError("an XBF record flag that isn't known")
            values = decode_record(h.fields, raw[at - low : at - low + size])
            yield (*(widened(x, f.tag) for x, f in zip(values, h.fields)), partition.first + i + 1, bool(flags))


def tag_of(c: T.StructField) -> int:
    if "xbf_tag" in (c.metadata or {}):
        return c.metadata["xbf_tag"]
    for kind, tag in ((T.BooleanType, BOOLEAN), (T.LongType, INT64), (T.IntegralType, INT32), (T.FloatType, FLOAT32), (T.DoubleType, FLOAT64), (T.BinaryType, BYTES), (T.DateType, DATE), (T.TimestampNTZType, TIMESTAMP), (T.TimestampType, TIMESTAMP), (T.StringType, STRING)):
        if isinstance(c.dataType, kind):
            return tag
    if isinstance(c.dataType, T.DecimalType) and c.dataType.scale == 0 and c.dataType.precision <= 20:
        return UINT64
    return JSON


def encode_one(tag: int, x) -> bytes:
    import json

    if x is None:
        return struct.pack("<BI", 0, 0)
    if tag == BOOLEAN:
        raw = b"\1" if x else b"\0"
    elif tag == DATE:
        raw = struct.pack("<i", (x - date(1970, 1, 1)).days)
    elif tag == TIMESTAMP:
        raw = struct.pack("<q", round((x.replace(tzinfo=None) - datetime(1970, 1, 1)) / timedelta(milliseconds=1)))
    elif tag in (INT32, INT64, UINT64, FLOAT32, FLOAT64):
        raw = struct.pack({INT32: "<i", INT64: "<q", UINT64: "<Q", FLOAT32: "<f", FLOAT64: "<d"}[tag], x if tag in (FLOAT32, FLOAT64) else int(x))
    elif tag == BYTES:
        raw = bytes(x)
    elif tag == UUID:
        raw = uuid.UUID(x).bytes
    else:
        raw = (x if isinstance(x, str) else json.dumps(x, default=str)).encode()
    return struct.pack("<BI", tag, len(raw)) + raw


def write_xbf(df: DataFrame, path: str, generation: int = 0) -> int:
    """Write df as one XBF file; the number of records.

    path: local, or a URI that driver and executors reach. Tasks encode records, their
    directory entries and checksums into part files beside it; the driver joins them.
    """
    import numpy as np
    import pyarrow as pa

    if "_record_number" in df.columns:
        df = df.orderBy("_record_number")
    fields = [XField(c.name, tag_of(c), (c.metadata or {}).get("xbf_flags", 1)) for c in df.schema if c.name not in ("_record_number", "_deleted")]
    names, has_mark, parts = [f.name for f in fields], "_deleted" in df.columns, f"{path}.parts-{uuid.uuid4().hex}"

    def run(batches):
        from pyspark import TaskContext

        task, size, count, crc = TaskContext.get(), 0, 0, 0
        name = f"{parts}/{task.partitionId():08d}-{task.taskAttemptId()}"
        with create_bytes(name + ".data") as data, create_bytes(name + ".spans") as spans:
            for b in batches:
                marks = b.column("_deleted").to_pylist() if has_mark else [False] * b.num_rows
                rows = [b"".join(encode_one(f.tag, x) for f, x in zip(fields, row)) for row in zip(*(b.column(n).to_pylist() for n in names))]
                raw, entries = b"".join(rows), np.zeros(len(rows), SPAN)
                entries["size"], entries["mark"] = [len(r) for r in rows], marks
                entries["at"] = size + np.cumsum(entries["size"]) - entries["size"]
                data.write(raw)
                spans.write(entries.tobytes())
                crc, size, count = crc32c(raw, crc), size + len(raw), count + len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (task.partitionId(), name, size, count, crc)], names=["part", "name", "size", "n", "crc"])

    schema = struct.pack("<I", len(fields)) + b"".join(struct.pack("<H", len(f.name.encode())) + f.name.encode() + struct.pack("<BBH", f.tag, f.flags, 0) for f in fields)
    try:
        written = {r["part"]: r for r in df.mapInArrow(run, "part long, name string, size long, n long, crc long").collect()}  # a row a partition
        order = [written[k] for k in sorted(written)]
        count, size = sum(r["n"] for r in order), sum(r["size"] for r in order)
        begin = HEADER + len(schema) + 24 * count
        data_crc = spans_crc = 0
        joined, at = f"{parts}/spans", begin
        with create_bytes(joined) as out:
            for r in order:
                with open_bytes(r["name"] + ".spans") as f:
                    while raw := f.read(24 << 16):
                        entries = np.frombuffer(raw, SPAN).copy()
                        entries["at"] += at
                        out.write(entries.tobytes())
                        spans_crc = crc32c(entries.tobytes(), spans_crc)
                at += r["size"]
                data_crc = crc32c_joined(data_crc, r["crc"], r["size"])
        head = MAGIC + struct.pack("<HHII", 1, 0, 0, HEADER) + struct.pack("<QQI", HEADER, len(schema), crc32c(schema)) + struct.pack("<QQI", HEADER + len(schema), 24 * count, spans_crc) + struct.pack("<QQI", begin, size, data_crc) + struct.pack("<QQ", count, generation)
        with create_bytes(path) as f:
            f.write(head + struct.pack("<II", crc32c(head + bytes(8)), 0) + schema)
            append_file(f, joined)
            for r in order:
                append_file(f, r["name"] + ".data")
    finally:
        remove_folder(parts)
    return count


#: An entry of the directory of records.
SPAN = [("at", "<u8"), ("size", "<u8"), ("mark", "<u4"), ("zero", "<u4")]


def dbf_to_xbf(spark: SparkSession, source: str, target: str, encoding: str | None = None) -> int:
    """Convert a DBF file (deleted records and memo texts included) into an XBF file; the number of records."""
    from . import dbf

    dbf.register(spark)
    reader = spark.read.format("dbf")
    df = (reader.option("encoding", encoding) if encoding else reader).load(source)
    return write_xbf(df, target)


def xbf_to_dbf(spark: SparkSession, source: str, target: str, width: int = 254, lossy: bool = False) -> int:
    """Convert an XBF file into a DBF file; the number of records. What a DBF can't hold as it is raises, unless lossy."""
    from . import dbf

    register(spark)
    df = spark.read.format("xbf").load(source)
    rows = df.drop("_record_number", "_deleted")
    if not lossy and (bad := [r["column"] + ": " + r["reason"] for r in representable(rows).collect()]):
        raise QueryError(f"a DBF can't hold this: {'; '.join(sorted(bad))}")
    for c in rows.schema:
        # metadata of the other format goes; what has no field type becomes text
        plain = F.col(f"`{c.name}`") if dbf.spark_type(dbf.field_for(T.StructField(c.name, c.dataType)), None).typeName() != "string" or isinstance(c.dataType, (T.StringType, T.DateType)) else F.col(f"`{c.name}`").cast("string")
        df = df.withColumn(c.name, plain.alias(c.name, metadata={}))
    return dbf.write_dbf(df, target)


def representable(df: DataFrame) -> DataFrame:
    """column, reason, n: values that a DBF of the usual field types can't hold as they are."""
    checks = []
    for c in df.schema:
        v = F.col(f"`{c.name}`")
        if isinstance(c.dataType, T.StringType):
            checks += [(c.name, "longer than 254 bytes", F.octet_length(v) > 254), (c.name, "trailing blanks", v.rlike(r"[ \x00]$")), (c.name, "empty text becomes null", v == "")]
        elif isinstance(c.dataType, (T.DoubleType, T.FloatType)):
            checks += [(c.name, "not finite", F.isnan(v) | (F.abs(v) == float("inf"))), (c.name, "more than 6 decimals", F.round(v, 6) != v)]
        elif isinstance(c.dataType, (T.ArrayType, T.StructType, T.MapType, T.BinaryType)):
            checks.append((c.name, "no field type", v.isNotNull()))
        elif isinstance(c.dataType, (T.TimestampType, T.TimestampNTZType)):
            checks.append((c.name, "time of day is lost", F.date_trunc("day", v) != v))
        if len(c.name.encode()) > 10:
            checks.append((c.name, "name longer than 10 bytes", F.lit(True)))
    if not checks:
        return df.sparkSession.createDataFrame([], "column string, reason string, n long")
    counted = df.agg(*(F.count_if(F.coalesce(x, F.lit(False))).alias(f"c{i}") for i, (_, _, x) in enumerate(checks)))
    rows = F.array(*(F.struct(F.lit(n).alias("column"), F.lit(r).alias("reason"), F.col(f"c{i}").alias("n")) for i, (n, r, _) in enumerate(checks)))
    return counted.select(F.explode(rows).alias("x")).select("x.*").where("n > 0")


def register(spark: SparkSession) -> None:
    from ..ship import ship

    ship(spark)
    spark.dataSource.register(XbfSource)

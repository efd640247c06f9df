"""DBF tables (dBASE III to 7, Visual FoxPro) with memo files: reader, Spark data source, writer.

Records have one width, so a file is read in ranges of records, one a task.
Every row has _record_number (from 1) and _deleted.
"""

from __future__ import annotations

import datetime
import math
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import QueryError
from .files import append_file, create_bytes, exists, open_bytes, read_range, remove_folder, size_of

# Language drivers and the code pages that they stand for.
CODE_PAGES = {
    0x01: "cp437", 0x02: "cp850", 0x1F: "cp852", 0x22: "cp852", 0x23: "cp852", 0x40: "cp852", 0x64: "cp852", 0x87: "cp852", 0x26: "cp866", 0x65: "cp866",
    0x03: "cp1252", 0x57: "cp1252", 0xC8: "cp1250", 0xC9: "cp1251", 0xCA: "cp1254", 0xCB: "cp1253", 0x7D: "cp1255", 0x7E: "cp1256",
    0x4F: "cp950", 0x78: "cp950", 0x4E: "cp949", 0x79: "cp949", 0x4D: "gbk", 0x7A: "gbk", 0x13: "cp932", 0x7B: "cp932",
}
FOXPRO = (0x30, 0x31, 0x32)
MEMO_TYPES = "MGPW"


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    width: int
    decimals: int = 0
    flags: int = 0
    offset: int = 0

    @property
    def hidden(self) -> bool:
        return bool(self.flags & 1)

    @property
    def nullable(self) -> bool:
        return bool(self.flags & 2)

    @property
    def binary(self) -> bool:
        return bool(self.flags & 4)


@dataclass(frozen=True)
class Header:
    version: int
    count: int
    header_length: int
    record_length: int
    driver: int
    fields: tuple[Field, ...]

    @property
    def foxpro(self) -> bool:
        return self.version in FOXPRO

    @property
    def encoding(self) -> str:
        return CODE_PAGES.get(self.driver, "utf-8")


def read_header(path: str, encoding: str | None = None) -> Header:
    with open_bytes(path) as f:
        head = f.read(32)
        if len(head) < 32:
            raise QueryError("the DBF header is truncated")
        version, count, header_length, record_length = head[0], *struct.unpack_from("<IHH", head, 4)
        f.seek(0)
        raw = f.read(header_length)
    if len(raw) < header_length:
        raise QueryError("the DBF header is truncated")
    level7 = version & 7 == 4
    at, step = (68, 48) if level7 else (32, 32)
    driver = head[29]
    code = encoding or CODE_PAGES.get(driver, "utf-8")
    fields, offset = [], 1
    while True:
        if at >= header_length:
            raise QueryError("the DBF field list has no end")
        if raw[at] == 0x0D:
            break
        d = raw[at : at + step]
        if len(d) < step:
            raise QueryError("a DBF field is truncated")
        name_width = 32 if level7 else 11
        name = d[:name_width].split(b"\0")[0].decode(code, "replace")
        kind, width, decimals = chr(d[name_width]), d[name_width + 5 if not level7 else 33], d[name_width + 6 if not level7 else 34]
        if not level7 and kind == "C" and decimals and version not in FOXPRO:
            width, decimals = width + 256 * decimals, 0
        fields.append(Field(name, kind, width, decimals, 0 if level7 else d[18], offset))
        offset += width
        at += step
    if offset != record_length:
        raise QueryError("the DBF record length doesn't fit its fields")
    return Header(version, count, header_length, record_length, driver, tuple(fields))


class Memo:
    """A DBT or FPT file."""

    def __init__(self, path: str, kind: str):
        self.path, self.kind, self.size = path, kind, size_of(path)
        head = read_range(path, 0, 512)
        if kind == "fpt":
            self.block = struct.unpack_from(">H", head, 6)[0] if len(head) >= 8 else 0
            if self.block < 8 or self.size < self.block:
                raise QueryError("the FPT header isn't valid")
        else:
            if len(head) < 512:
                raise QueryError("the DBT header is truncated")
            self.block = (struct.unpack_from("<H", head, 20)[0] or 512) if kind == "dbt4" else 512

    def read(self, block: int) -> bytes | None:
        if block <= 0:
            return None
        begin = block * self.block
        if begin >= self.size:
            raise QueryError(f"memo block {block} lies outside its file")
        if self.kind == "dbt3":
            out = b""
            while begin < self.size:
                out += read_range(self.path, begin, 1 << 16)
                begin += 1 << 16
                end = out.find(b"\x1a\x1a")
                if end >= 0:
                    return out[:end]
            end = out.find(b"\x1a")
            return out[:end] if end >= 0 and not out[end:].strip(b"\0 \x1a") else out
        head = read_range(self.path, begin, 8)
        length = struct.unpack_from(">I", head, 4)[0] if self.kind == "fpt" else struct.unpack_from("<I", head, 4)[0] - 8
        data = read_range(self.path, begin + 8, length) if length >= 0 else b""
        if len(head) < 8 or length < 0 or len(data) < length:
            raise QueryError("memo data is truncated")
        return data


def memo_of(path: str, header: Header) -> Memo | None:
    if not any(f.type in MEMO_TYPES or (f.type == "B" and not header.foxpro) for f in header.fields):
        return None
    stem = path[: path.rfind(".")]
    for end in (".fpt", ".FPT"):
        if exists(stem + end):
            return Memo(stem + end, "fpt")
    for end in (".dbt", ".DBT"):
        if exists(stem + end):
            return Memo(stem + end, "dbt3" if header.version == 0x83 else "dbt4")
    return None


def spark_type(f: Field, header: Header | None) -> T.DataType:
    if f.type in "NF":
        return T.LongType() if f.decimals == 0 else T.DoubleType()
    if f.type == "L":
        return T.BooleanType()
    if f.type in "I+":
        return T.IntegerType()
    if f.type == "O" or (f.type == "B" and f.width == 8 and header is not None and header.foxpro):
        return T.DoubleType()
    return T.StringType()


def schema_of(header: Header) -> T.StructType:
    out = T.StructType()
    for f in header.fields:
        if not f.hidden:
            out.add(T.StructField(f.name, spark_type(f, header), True, {"dbf_type": f.type, "width": f.width, "decimals": f.decimals, "flags": f.flags}))
    return out.add("_record_number", T.LongType()).add("_deleted", T.BooleanType())


def number(raw: bytes, whole: bool):
    """The number of an N or F field; null where it is blank or no number of the column's type."""
    text = raw.replace(b"\0", b" ").strip().decode("ascii", "replace")
    try:
        if whole:
            return int(text) if text.lstrip("+-").isdigit() else int(float(text))
        x = float(text)
        return x if math.isfinite(x) else None
    except (ValueError, OverflowError):
        return None


def moment(raw: bytes) -> str | None:
    """A FoxPro date and time as ISO text: a Julian day number and milliseconds."""
    day, ms = struct.unpack("<iI", raw)
    if day == 0:
        return None
    try:
        t = datetime.datetime.combine(datetime.date.fromordinal(day - 1721425), datetime.time()) + datetime.timedelta(seconds=round(ms / 1000))
    except (ValueError, OverflowError):
        return raw.hex()
    return t.isoformat(timespec="seconds")


class Decoder:
    def __init__(self, header: Header, memo: Memo | None, encoding: str | None):
        self.header, self.memo, self.code = header, memo, encoding or header.encoding
        self.null_flags = next((f for f in header.fields if f.type == "0"), None)
        self.bits: dict[str, tuple[int | None, int | None]] = {}
        bit = 0
        for f in header.fields:
            var = null = None
            if f.type in "VQ":
                var, bit = bit, bit + 1
            if f.nullable:
                null, bit = bit, bit + 1
            self.bits[f.name] = (var, null)

    def text(self, raw: bytes) -> str:
        return raw.rstrip(b" \0").decode(self.code, "replace")

    def value(self, f: Field, raw: bytes, flags: int):
        var, null = self.bits[f.name]
        if null is not None and flags >> null & 1:
            return None
        kind = f.type
        if kind in "VQ":
            if var is not None and flags >> var & 1:
                raw = raw[: raw[-1]]
            return self.text(raw) if kind == "V" and not f.binary else raw.hex()
        if kind in MEMO_TYPES or (kind == "B" and not self.header.foxpro and f.width != 4):
            return self.memo_value(f, raw)
        if kind in "NF":
            return number(raw, f.decimals == 0)
        if kind == "L":
            return {b"T": True, b"t": True, b"Y": True, b"y": True, b"F": False, b"f": False, b"N": False, b"n": False}.get(raw[:1])
        if kind == "D":
            return self.text(raw).strip() or None
        if kind == "T" and self.header.foxpro and len(raw) == 8:
            return moment(raw)
        if kind == "Y" and len(raw) == 8:
            x = struct.unpack("<q", raw)[0]
            return f"{'-' if x < 0 else ''}{abs(x) // 10000}.{abs(x) % 10000:04d}"
        if kind in "I+" and len(raw) == 4:
            return struct.unpack("<i", raw)[0]
        if (kind == "B" or kind == "O") and len(raw) == 8:
            x = struct.unpack("<d", raw)[0]
            return x if math.isfinite(x) else None
        if kind in "@T" or f.binary:
            return raw.hex()
        return self.text(raw)

    def memo_value(self, f: Field, raw: bytes):
        block = struct.unpack("<I", raw)[0] if f.width == 4 else number(raw, True)
        if not block:
            return None
        if self.memo is None:
            raise QueryError("the table has memo fields and no memo file")
        data = self.memo.read(block)
        if data is None:
            return None
        return data.decode(self.code, "replace") if f.type == "M" and not f.binary else data.hex()

    def records(self, raw: bytes, first: int) -> Iterator[tuple]:
        width = self.header.record_length
        for i in range(len(raw) // width):
            r = raw[i * width : (i + 1) * width]
            if r[0] not in (0x20, 0x2A):
                raise QueryError(f"record {first + i} has no valid deletion mark")
            flags = 0
            if self.null_flags:
                f = self.null_flags
                flags = int.from_bytes(r[f.offset : f.offset + f.width], "little")
            yield (*(self.value(f, r[f.offset : f.offset + f.width], flags) for f in self.header.fields if not f.hidden), first + i, r[0] == 0x2A)


class DbfSource(DataSource):
    """spark.read.format("dbf").load(path); options: encoding, rows (records of a task)."""

    @classmethod
    def name(cls) -> str:
        return "dbf"

    def schema(self):
        return schema_of(read_header(self.options["path"], self.options.get("encoding")))

    def reader(self, schema):
        return DbfReader(self.options)


@dataclass
class Records(InputPartition):
    first: int
    count: int


class DbfReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.encoding = options["path"], options.get("encoding")
        self.rows = int(options.get("rows", 100_000))
        self.header = read_header(self.path, self.encoding)

    def partitions(self):
        h = self.header
        there = (size_of(self.path) - h.header_length) // h.record_length
        if there < h.count:
            raise QueryError("DBF records are missing")
        return [Records(i, min(self.rows, h.count - i)) for i in range(0, h.count, self.rows)] or [Records(0, 0)]

    def read(self, partition):
        h = self.header
        raw = read_range(self.path, h.header_length + partition.first * h.record_length, partition.count * h.record_length)
        yield from Decoder(h, memo_of(self.path, h), self.encoding).records(raw, partition.first + 1)


def encode_value(f: Field, x, code: str) -> bytes:
    """A value as the field's bytes; an error where it doesn't fit."""
    if f.type in "NF":
        if x is None:
            return b" " * f.width
        text = f"{x:.{f.decimals}f}" if f.decimals else str(int(x))
        raw = text.encode().rjust(f.width)
    elif f.type == "L":
        raw = b"?" if x is None else b"T" if x else b"F"
    elif f.type == "D":
        raw = (x.strftime("%Y%m%d") if isinstance(x, datetime.date) else x or "").encode().ljust(8)
    elif f.type == "I":
        return struct.pack("<i", x or 0)
    elif f.type == "B":
        return struct.pack("<d", x or 0.0)
    else:
        raw = ("" if x is None else str(x)).encode(code).ljust(f.width)
    if len(raw) != f.width:
        raise QueryError(f"a value of {f.name} doesn't fit: {x!r}")
    return raw


def field_for(c: T.StructField, width: int = 254) -> Field:
    """The field that holds a column; the column's metadata wins."""
    m = c.metadata or {}
    if "dbf_type" in m:
        return Field(c.name, m["dbf_type"], m["width"], m["decimals"], m.get("flags", 0))
    t = c.dataType
    if isinstance(t, T.IntegralType):
        return Field(c.name, "N", 20)
    if isinstance(t, T.NumericType):
        return Field(c.name, "N", 20, 6)
    if isinstance(t, T.BooleanType):
        return Field(c.name, "L", 1)
    if isinstance(t, T.DateType):
        return Field(c.name, "D", 8)
    return Field(c.name, "C", width)


def header_bytes(fields: list[Field], count: int, driver: int = 0x03, version: int = 0x03, code: str = "cp1252") -> bytes:
    today = datetime.date.today()
    out = struct.pack("<BBBBIHH", version, today.year % 100, today.month, today.day, count, 32 + 32 * len(fields) + 1, 1 + sum(f.width for f in fields)) + bytes(17) + bytes([driver, 0, 0])
    for f in fields:
        name = f.name.encode(code)
        if len(name) > 10:
            raise QueryError(f"a DBF name has 10 bytes at most: {f.name}")
        out += name.ljust(11, b"\0") + f.type.encode() + bytes(4) + bytes([f.width, f.decimals, f.flags]) + bytes(13)
    return out + b"\x0d"


def write_dbf(df: DataFrame, path: str, driver: int = 0x03) -> int:
    """Write df (a column _deleted marks deleted rows; _record_number orders them) as one DBF file; the number of records.

    path: local, or a URI that driver and executors reach. Tasks encode records into
    part files beside it; the driver joins them behind a header, as the format is one file.
    """
    import pyarrow as pa

    code = CODE_PAGES[driver]
    if "_record_number" in df.columns:
        df = df.orderBy("_record_number")
    fields = [field_for(c) for c in df.schema if c.name not in ("_record_number", "_deleted")]
    if any(f.type in MEMO_TYPES for f in fields):
        raise QueryError("memo fields can't be written; cast them to text of fixed width")
    names, has_mark, parts = [f.name for f in fields], "_deleted" in df.columns, f"{path}.parts-{uuid.uuid4().hex}"

    def run(batches):
        from pyspark import TaskContext

        task, total = TaskContext.get(), 0
        name = f"{parts}/{task.partitionId():08d}-{task.taskAttemptId()}"
        with create_bytes(name) as out:
            for b in batches:
                columns = [b.column(n).to_pylist() for n in names]
                marks = b.column("_deleted").to_pylist() if has_mark else [False] * b.num_rows
                out.write(b"".join((b"*" if m else b" ") + b"".join(encode_value(f, x, code) for f, x in zip(fields, row)) for m, row in zip(marks, zip(*columns))))
                total += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([name]), pa.array([total], pa.int64())], names=["part", "name", "n"])

    try:
        written = {r["part"]: r for r in df.mapInArrow(run, "part int, name string, n long").collect()}  # a row a partition
        total = sum(r["n"] for r in written.values())
        with create_bytes(path) as f:
            f.write(header_bytes(fields, total, driver, code=code))
            for k in sorted(written):
                append_file(f, written[k]["name"])
            f.write(b"\x1a")
    finally:
        remove_folder(parts)
    return total


def register(spark: SparkSession) -> None:
    from ..ship import ship

    ship(spark)
    spark.dataSource.register(DbfSource)

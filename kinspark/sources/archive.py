"""Archives as tables: entries of ZIP files, and the class files in them down to their instructions."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ship

ENTRIES = "archive string, path string, size long, crc32 string, sha256 string, error string, content binary"
DIRECTORY = "archive string, path string, size long, crc32 string, error string"
MEMBER = "name: string, descriptor: string, access: int, attributes: array<string>, code_length: int"
CLASSES = f"archive string, path string, class_name string, super_name string, access int, major int, interfaces array<string>, fields array<struct<{MEMBER}>>, methods array<struct<{MEMBER}>>, attributes array<string>, strings array<string>, numbers array<string>, constants array<string>, refs array<string>, structure string, error string"
INSTRUCTIONS = "archive string, path string, method string, offset int, opcode int, ref string, targets array<int>"

#: Bytes that follow the tag of each constant-pool entry of fixed size; text entries (1) carry their length.
POOL_SIZES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
_NUMBERS = {3: ">i", 4: ">f", 5: ">q", 6: ">d"}
_EPOCH = (1980, 1, 1, 0, 0, 0)


def files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, content) of the files under a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select("path", "content")


def _rows(archives: DataFrame, schema: str, read: Callable[[zipfile.ZipFile, zipfile.ZipInfo], tuple]) -> DataFrame:
    """A row per entry of each archive (path, content), where the archive is; one that can't be read has an error."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k] for k in kinds]
    blank = (None,) * (len(names) - 2)

    def failed(e: Exception, size: int | None) -> tuple:
        return tuple(str(e) if n == "error" else size if n == "size" else x for n, x in zip(names[2:], blank, strict=True))

    def run(batches):
        for batch in batches:
            for archive, blob in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(blob)) as z:
                        for info in z.infolist():
                            if not info.is_dir():
                                try:
                                    rows.append((archive, info.filename, *read(z, info)))
                                except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError) as e:
                                    rows.append((archive, info.filename, *failed(e, info.file_size)))
                except zipfile.BadZipFile as e:
                    rows.append((archive, None, *failed(e, None)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(names), types, strict=True)], list(names))

    ship(archives.sparkSession)
    return archives.select("path", "content").mapInArrow(run, schema)


def entries_of(archives: DataFrame, content: bool = False) -> DataFrame:
    """One row per entry of archives (path, content): size, CRC-32, SHA-256, and the bytes if wanted."""

    def read(z: zipfile.ZipFile, info: zipfile.ZipInfo) -> tuple:
        raw = z.read(info)
        return len(raw), f"{zlib.crc32(raw):08x}", hashlib.sha256(raw).hexdigest(), None, raw if content else None

    return _rows(archives, ENTRIES, read)


def entries(spark: SparkSession, path: str, glob: str = "*.jar", content: bool = False) -> DataFrame:
    return entries_of(files(spark, path, glob), content)


def directory_of(archives: DataFrame) -> DataFrame:
    """One row per entry from the archives' directories alone; nothing is decompressed."""
    return _rows(archives, DIRECTORY, lambda _, info: (info.file_size, f"{info.CRC:08x}", None))


def duplicates(directory: DataFrame) -> DataFrame:
    """(archive, path, n) of names that an archive has more than once; a manifest must have none."""
    return directory.where("path IS NOT NULL").groupBy("archive", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def lookup(archives: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of wanted entries (archive, path) alone: archives without any are not opened, and others are
    decompressed only there. Wanted names of one archive travel beside it."""
    asked = wanted.groupBy("archive").agg(F.collect_set("path").alias("names"))
    pairs = archives.join(asked.withColumnRenamed("archive", "path"), "path")

    def run(batches):
        for batch in batches:
            for archive, blob, names in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "names")), strict=True):
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    held = [n for n in names if n in z.NameToInfo]
                    yield pa.RecordBatch.from_arrays([pa.array([archive] * len(held), pa.string()), pa.array(held, pa.string()), pa.array([z.read(n) for n in held], pa.binary())], ["archive", "path", "content"])

    ship(archives.sparkSession)
    return pairs.select("path", "content", "names").mapInArrow(run, "archive string, path string, content binary")


def packed(rows: DataFrame) -> DataFrame:
    """(path, content) of a ZIP file per archive from rows (archive, path, content): entries by name, without times,
    so that equal entries make equal bytes. An archive is made in one task's memory, as it is one file."""

    def zipped(frame: pd.DataFrame) -> pd.DataFrame:
        sink = io.BytesIO()
        frame = frame.sort_values(["path", "content"])
        with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                z.writestr(zipfile.ZipInfo(path, _EPOCH), bytes(content), zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"path": [frame["archive"].iloc[0]], "content": [sink.getvalue()]})

    ship(rows.sparkSession)
    return rows.select("archive", "path", "content").groupBy("archive").applyInPandas(zipped, "path string, content binary")


def modified_utf8(raw: bytes) -> str:
    """Text of class files: NUL in two bytes, and characters beyond the basic plane as two surrogates of three bytes each."""
    text = raw.replace(b"\xc0\x80", b"\x00").decode("utf-8", "surrogatepass")
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


class Pool:
    """The constant pool of a class file; ``end`` is where it ends."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"\xca\xfe\xba\xbe":
            raise ValueError("not a class file")
        (count,) = struct.unpack_from(">H", raw, 8)
        at, self.items, i = 10, {}, 1
        while i < count:
            tag = raw[at]
            if tag == 1:
                (n,) = struct.unpack_from(">H", raw, at + 1)
                self.items[i] = (1, modified_utf8(raw[at + 3 : at + 3 + n]))
                at += 3 + n
            else:
                self.items[i] = (tag, raw[at + 1 : at + 1 + POOL_SIZES[tag]])
                at += 1 + POOL_SIZES[tag]
            i += 2 if tag in (5, 6) else 1
        self.end = at

    def text(self, index: int) -> str:
        return self.items[index][1]

    def name(self, index: int) -> str | None:
        return self.text(struct.unpack(">H", self.items[index][1])[0]) if index else None

    def ref(self, index: int) -> str | None:
        """``owner.name:descriptor`` of a field or method; the name of a class; null for anything else."""
        tag, body = self.items.get(index, (0, b""))
        if tag == 7:
            return self.name(index)
        if tag not in (9, 10, 11):
            return None
        owner, pair = struct.unpack(">HH", body)
        name, kind = struct.unpack(">HH", self.items[pair][1])
        return f"{self.name(owner)}.{self.text(name)}:{self.text(kind)}"

    def refs(self) -> list[str]:
        return sorted({self.ref(i) for i, (tag, _) in self.items.items() if tag in (9, 10, 11)})


def _attributes(raw: bytes, at: int, pool: Pool) -> tuple[list[tuple[str, bytes]], int]:
    (n,) = struct.unpack_from(">H", raw, at)
    at, found = at + 2, []
    for _ in range(n):
        name, size = struct.unpack_from(">HI", raw, at)
        found.append((pool.text(name), raw[at + 6 : at + 6 + size]))
        at += 6 + size
    return found, at


def _members(raw: bytes, at: int, pool: Pool) -> tuple[list[list[tuple]], int]:
    """Fields and methods as (name, descriptor, access, attributes), and where they end."""
    groups = []
    for _ in range(2):
        (n,) = struct.unpack_from(">H", raw, at)
        at += 2
        group = []
        for _ in range(n):
            flags, own, kind = struct.unpack_from(">HHH", raw, at)
            found, at = _attributes(raw, at + 6, pool)
            group.append((pool.text(own), pool.text(kind), flags, found))
        groups.append(group)
    return groups, at


def class_head(raw: bytes) -> dict:
    """Names, members, attributes, constants and references of one class file. ``structure`` is a hash of what
    renaming leaves alone: access flags, member counts and descriptors without class names."""
    pool = Pool(raw)
    (major,) = struct.unpack_from(">H", raw, 6)
    access, this, parent, n = struct.unpack_from(">HHHH", raw, pool.end)
    at = pool.end + 8
    interfaces = [pool.name(struct.unpack_from(">H", raw, at + 2 * k)[0]) for k in range(n)]
    groups, at = _members(raw, at + 2 * n, pool)
    own, _ = _attributes(raw, at, pool)
    members = [[{"name": a, "descriptor": d, "access": f, "attributes": sorted(k for k, _ in x), "code_length": next((struct.unpack_from(">I", v, 4)[0] for k, v in x if k == "Code"), None)} for a, d, f, x in g] for g in groups]
    strings = sorted({pool.text(struct.unpack(">H", v)[0]) for t, v in pool.items.values() if t == 8})
    numbers = sorted(repr(struct.unpack(_NUMBERS[t], v)[0]) for t, v in pool.items.values() if t in _NUMBERS)
    constants = sorted({v for t, v in pool.items.values() if t == 1})
    shape = sorted((k, m["access"], re.sub("L[^;]*;", "L", m["descriptor"])) for k, g in enumerate(members) for m in g)
    structure = hashlib.sha256(repr((access, major, len(interfaces), shape)).encode()).hexdigest()
    return {"class_name": pool.name(this), "super_name": pool.name(parent), "access": access, "major": major, "interfaces": interfaces, "fields": members[0], "methods": members[1], "attributes": sorted(k for k, _ in own), "strings": strings, "numbers": numbers, "constants": constants, "refs": pool.refs(), "structure": structure, "error": None}


#: Opcodes by the bytes of their operands; all others have none, but for the two switches and wide.
OPERANDS = {1: [16, 18, *range(21, 26), *range(54, 59), 169, 188], 2: [17, 19, 20, 132, *range(153, 169), *range(178, 185), 187, 189, 192, 193, 198, 199], 3: [197], 4: [185, 186, 200, 201]}
_OPERANDS = {op: n for n, ops in OPERANDS.items() for op in ops}
_JUMPS = {*range(153, 169), 198, 199, 200, 201}
_POOLED = {19, 20, *range(178, 187), 187, 189, 192, 193, 197}


def instructions(code: bytes) -> Iterator[tuple[int, int, int | None, list[int]]]:
    """(offset, opcode, constant-pool index, targets of jumps) of each instruction of a method's code."""
    at = 0
    while at < len(code):
        op, index, targets = code[at], None, []
        end = at + 1 + _OPERANDS.get(op, 0)
        if end > len(code):
            raise ValueError(f"the instruction at {at} goes beyond the code")
        if op == 196:
            end = at + (6 if code[at + 1 : at + 2] == b"\x84" else 4)
        elif op in (170, 171):
            base = at + 4 - at % 4
            default, low = struct.unpack_from(">ii", code, base)
            if op == 170:
                n = struct.unpack_from(">i", code, base + 8)[0] - low + 1
                steps = struct.unpack_from(f">{n}i", code, base + 12)
                end = base + 12 + 4 * n
            else:
                steps = struct.unpack_from(f">{2 * low}i", code, base + 8)[1::2]
                end = base + 8 + 8 * low
            targets = sorted({at + x for x in (default, *steps)})
        elif op in _JUMPS:
            targets = [at + struct.unpack_from(">i" if op >= 200 else ">h", code, at + 1)[0]]
        elif op in _POOLED:
            index = struct.unpack_from(">H", code, at + 1)[0]
        elif op == 18:
            index = code[at + 1]
        if end > len(code):
            raise ValueError(f"the instruction at {at} goes beyond the code")
        yield at, op, index, targets
        at = end


def method_rows(raw: bytes) -> list[tuple]:
    """(method, offset, opcode, ref, targets) of every instruction of a class file."""
    pool = Pool(raw)
    (n,) = struct.unpack_from(">H", raw, pool.end + 6)
    groups, _ = _members(raw, pool.end + 8 + 2 * n, pool)
    rows = []
    for name, kind, _, found in groups[1]:
        for body in (v for k, v in found if k == "Code"):
            (size,) = struct.unpack_from(">I", body, 4)
            rows += [(f"{name}{kind}", at, op, pool.ref(i) if i else None, to) for at, op, i, to in instructions(body[8 : 8 + size])]
    return rows


def class_files(spark: SparkSession, path: str, glob: str = "*.jar") -> DataFrame:
    """(archive, path, content) of the class files in archives or, with a glob of class files, in folders."""
    if glob.endswith(".class"):
        return files(spark, path, glob).select(F.lit(path).alias("archive"), "path", "content")
    return entries(spark, path, glob, content=True).where("path LIKE '%.class' AND content IS NOT NULL").select("archive", "path", "content")


def classes(spark: SparkSession, path: str, glob: str = "*.jar") -> DataFrame:
    """One row per class file; one that can't be parsed has an error."""
    columns = [c.split()[0] for c in re.sub("<.*?>+", "", CLASSES).split(", ")][2:]
    empty = dict.fromkeys(columns)

    def run(frames):
        for frame in frames:
            rows = []
            for archive, entry, raw in zip(frame["archive"], frame["path"], frame["content"], strict=True):
                try:
                    head = class_head(bytes(raw))
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    head = empty | {"error": f"{type(e).__name__}: {e}"}
                rows.append({"archive": archive, "path": entry} | head)
            if rows:
                yield pd.DataFrame(rows)

    ship(spark)
    return class_files(spark, path, glob).mapInPandas(run, CLASSES)


def bytecode(spark: SparkSession, path: str, glob: str = "*.jar") -> DataFrame:
    """One row per instruction of every method: offset, opcode, what it refers to and where it may jump. Class files
    that can't be parsed have no rows here and an error in ``classes``."""

    def run(frames):
        for frame in frames:
            rows = []
            for archive, entry, raw in zip(frame["archive"], frame["path"], frame["content"], strict=True):
                try:
                    rows += [(archive, entry, *r) for r in method_rows(bytes(raw))]
                except (ValueError, KeyError, IndexError, struct.error):
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in INSTRUCTIONS.split(", ")])

    ship(spark)
    return class_files(spark, path, glob).mapInPandas(run, INSTRUCTIONS)

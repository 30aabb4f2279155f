"""The packed genome format: a header, names, and two bases to a byte.

Fixed values: marker 0x01020304, versions 1 and 2, little-endian 32-bit
fields, sequences filled up with X to four bytes.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.sequences import CODES, wrapped
from strandweave.session import ship

MARKER = 0x01020304
_LETTERS = np.frombuffer(CODES.encode(), np.uint8)
_CODE = np.full(256, CODES.index("X"), np.uint8)
for _n, _c in enumerate(CODES):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _n
_CODE[ord("U")] = _CODE[ord("u")] = CODES.index("T")


def encode(sequences: list[tuple[str, str]]) -> bytes:
    """Version 2 of the format, for (name, bases) pairs."""
    heads, names, bodies, at = [], [], [], 0
    name_at = 0
    for name, seq in sequences:
        raw = name.encode()
        codes = _CODE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
        size = -(-len(codes) // 8) * 8
        full = np.full(size, CODES.index("X"), np.uint8)
        full[: len(codes)] = codes
        bodies.append((full[0::2] << 4 | full[1::2]).tobytes())
        heads.append(struct.pack("<4I", at, len(codes), name_at, len(raw)))
        names.append(raw)
        at += size // 2
        name_at += len(raw)
    text = b"".join(names)
    text += b"\0" * (-len(text) % 4)
    start = 20 + 16 * len(heads) + len(text)
    return struct.pack("<4I", MARKER, 2, start, len(heads)) + b"".join(heads) + struct.pack("<I", 0) + text + b"".join(bodies)


def decode(data: bytes) -> list[tuple[str, str]]:
    marker, version, start, count = struct.unpack_from("<4I", data)
    if marker != MARKER or version not in (1, 2):
        raise ValueError("no packed genome of version 1 or 2")
    width = 12 if version == 1 else 16
    names = 16 + width * count + 4
    out = []
    for i in range(count):
        fields = struct.unpack_from(f"<{width // 4}I", data, 16 + width * i)
        at, length = fields[:2]
        name_at, name_len = (fields[2] >> 16, fields[2] & 0xFFFF) if version == 1 else fields[2:]
        packed = np.frombuffer(data, np.uint8, -(-length // 2), start + at)
        codes = np.stack([packed >> 4, packed & 15], 1).ravel()[:length]
        out.append((data[names + name_at : names + name_at + name_len].decode(), _LETTERS[codes].tobytes().decode()))
    return out


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, name, seq) of packed files; a file is one task's row, sequence numbers follow paths and places."""
    ship(spark)

    def run(batches):
        for b in batches:
            rows = [(p, i, n, s) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, (n, s) in enumerate(decode(c))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.int64(), pa.string(), pa.string()))], ["file", "n", "name", "seq"])

    from strandweave.sources.text import _ids

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return _ids(files.mapInArrow(run, "file string, n long, name string, seq string")).select(F.col("id").alias("seq_id"), "name", "seq")


def pack(sequences: DataFrame, files: int = 1) -> DataFrame:
    """(part, content): packed files, sequences dealt over `files` of them in order of seq_id."""
    ship(sequences.sparkSession)

    def run(_, t):
        t = t.sort_by("seq_id")
        return pa.table({"part": t.column("part").slice(0, 1), "content": pa.array([encode(list(zip(t.column("name").to_pylist(), t.column("seq").to_pylist())))], pa.binary())})

    return sequences.select("seq_id", "name", "seq", F.pmod(F.xxhash64("seq_id"), F.lit(files)).cast("int").alias("part")).groupBy("part").applyInArrow(run, "part int, content binary")


def write_packed(sequences: DataFrame, path: str, files: int = 1) -> None:
    """Save packed files under path, one at a time, by Hadoop's file system layer."""
    jvm = sequences.sparkSession._jvm
    conf = sequences.sparkSession._jsc.hadoopConfiguration()
    for row in pack(sequences, files).toLocalIterator():
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/part-{row['part']:05d}.nib2")
        out = target.getFileSystem(conf).create(target, True)
        out.write(bytearray(row["content"]))
        out.close()


def write_fasta(sequences: DataFrame, path: str, width: int = 50) -> None:
    """Text files of > name lines and lines of `width` bases."""
    lines = sequences.repartitionByRange("seq_id").sortWithinPartitions("seq_id")
    lines.select(F.concat(F.lit(">"), "name", F.lit("\n"), wrapped(F.col("seq"), width)).alias("value")).write.mode("overwrite").text(path)


def newer_than(spark: SparkSession, made: str, source: str) -> bool:
    """Is what lies at made at least as new as every file at source?"""
    when = lambda path: spark.read.format("binaryFile").load(path).agg(F.max("modificationTime")).first()[0]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(made)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return False
    a, b = when(made), when(source)
    return bool(a and b and a >= b)

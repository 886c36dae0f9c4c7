"""Token ids as flat binary files with 64-bit offsets.

A folder holds, for each range of ids ``NNNNN``:

* ``NNNNN.ids``: little-endian unsigned integers (16 bits if the vocabulary fits, else 32), nothing else
* ``NNNNN.offsets``: unsigned 64-bit places, over all files, where each document starts, and the end of the last
* ``NNNNN.docs``: the signed 64-bit document ids (``NULL_ID`` for null)

Documents stand in ascending id order over the files. A file is written under
another name and then renamed, so a task that is tried again leaves the same files.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horizonkit.llm.common import as_bytes, slices
from horizonkit.llm.encode import encoder

NULL_ID = np.iinfo(np.int64).min
#: Text bytes, and rows, that a file is planned for.
FILE_BYTES, FILE_ROWS = 1 << 26, 1 << 20
#: Documents and ids read back at a time; a longer document is read in pieces.
READ_ROWS, READ_IDS = 4096, 1 << 20


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder the executors share."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class _Output:
    """A file that appears under its name when it is complete."""

    def __init__(self, folder: str, name: str):
        self.fs, top = _at(folder)
        self.fs.create_dir(top)
        self.path, self.part = f"{top}/{name}", f"{top}/.{name}-{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.part)

    def write(self, data) -> None:
        self.stream.write(data)

    def close(self) -> None:
        self.stream.close()
        if not isinstance(self.fs, fs.LocalFileSystem) and self.fs.get_file_info(self.path).type == fs.FileType.File:
            self.fs.delete_file(self.path)  # only local renames replace a file
        self.fs.move(self.part, self.path)


class _Input:
    """Ranges of a file of integers: memory-mapped where it has a local path, else read range by range."""

    def __init__(self, folder: str, name: str, dtype: str):
        system, top = _at(folder)
        path, self.dtype = f"{top}/{name}", np.dtype(dtype)
        self.size = system.get_file_info(path).size // self.dtype.itemsize
        local = isinstance(system, fs.LocalFileSystem)
        self.mapped = np.memmap(path, self.dtype, "r") if local and self.size else None
        self.file = None if local else system.open_input_file(path)

    def read(self, start: int, end: int) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[start:end]
        if self.file is None:
            return np.empty(0, self.dtype)
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((end - start) * width, start * width), self.dtype)


def _array(folder: str, name: str, dtype: str) -> np.ndarray:
    """A whole file as an array."""
    file = _Input(folder, name, dtype)
    return file.read(0, file.size)


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id",
                 text_col: str = "text", files: int | None = None) -> DataFrame:
    """Tokenize every text and write the files; returns ``(part, base, dtype)``, a row per file set.

    ``vocabulary``: path of a tokenizers file, the same on every executor. Each
    document ends with ``end_id``. A null text has that id alone; a null id
    comes first. Rows of equal id stand in the order of their texts within a
    file. Texts are tokenized whole. Other columns play no part; an empty
    table writes nothing and returns no rows. ``files``: by default one for each
    ``FILE_BYTES`` of text or ``FILE_ROWS`` rows, at least as many as shuffle partitions.
    """
    spark = docs.sparkSession
    if files is None:
        n, size = docs.agg(F.count("*"), F.sum(F.octet_length(F.col(text_col).cast("string")))).first()  # two numbers
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // FILE_ROWS), -(-(size or 0) // FILE_BYTES))
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
            .withColumn("tie", F.monotonically_increasing_id()))  # spreads a hot id over files
    ranged = rows.repartitionByRange(files, "id", "tie").drop("tie").sortWithinPartitions("id", "text")

    def write(batches):
        part, outs, total, end = TaskContext.get().partitionId(), [], 0, np.array([end_id], "<u4").tobytes()
        for b in slices(batches):
            enc = encoder(vocabulary)
            dtype = id_type(enc.tokenizer.get_vocab_size())
            outs = outs or [_Output(folder, f"{part:05d}.{name}") for name in ("ids", "docs", "starts")]
            ids = [enc.encode(t) for t in as_bytes(b.column(1))]
            n = np.array([len(x) // 4 + 1 for x in ids], np.uint64)
            outs[0].write(np.frombuffer(end.join([*ids, b""]), "<u4").astype(dtype).tobytes())
            outs[1].write(b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            outs[2].write((np.cumsum(n) - n + np.uint64(total)).astype("<u8").tobytes())
            total += int(n.sum())
        if outs:
            outs[2].write(np.array([total], "<u8").tobytes())
            for f in outs:
                f.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([total], pa.int64()), "dtype": [dtype]})

    sizes = sorted(tuple(r) for r in ranged.mapInArrow(write, "part int, n long, dtype string").collect())  # a row per file
    bases, base = [], 0
    for part, n, dtype in sizes:
        bases.append((part, base, dtype))
        base += n
    table = spark.createDataFrame(bases, "part int, base long, dtype string")
    table = table.repartition(max(1, len(bases)))

    def place(batches):
        for b in batches:
            for part, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f, starts = _Output(folder, f"{part:05d}.offsets"), _Input(folder, f"{part:05d}.starts", "<u8")
                for at in range(0, starts.size, READ_IDS):
                    f.write((starts.read(at, min(at + READ_IDS, starts.size)) + np.uint64(base)).astype("<u8").tobytes())
                f.close()
            yield b

    done = table.mapInArrow(place, "part int, base long, dtype string").collect()
    return spark.createDataFrame(done, "part int, base long, dtype string")


def checksums(ids: _Input, at: np.ndarray) -> list[int]:
    """crc32 of each document's ids as 32-bit integers; ``at``: where they start in the file, and the last one's end."""
    out, i = [], 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + READ_IDS, "right")) - 1)  # whole documents of at most READ_IDS ids, or one
        first, last = int(at[i]), int(at[j])
        if j > i + 1 or last - first <= READ_IDS:
            data = memoryview(ids.read(first, last).astype("<u4").tobytes())
            ends = ((at[i:j + 1] - first) * 4).tolist()
            out += [zlib.crc32(data[a:z]) for a, z in zip(ends, ends[1:], strict=False)]
        else:
            crc = 0
            for a in range(first, last, READ_IDS):
                crc = zlib.crc32(ids.read(a, min(a + READ_IDS, last)).astype("<u4").tobytes(), crc)
            out.append(crc)
        i = j
    return out


def read_tokens(spark: SparkSession, folder: str, parts: DataFrame) -> DataFrame:
    """Read the files back: per document ``id, start, n_tokens, ids_crc32`` (of 32-bit ids, end id included)."""
    def read(batches):
        for b in batches:
            for part, dtype in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = _Input(folder, f"{part:05d}.ids", dtype)
                starts, docs = _Input(folder, f"{part:05d}.offsets", "<u8"), _Input(folder, f"{part:05d}.docs", "<i8")
                base = int(starts.read(0, 1)[0])
                for i in range(0, docs.size, READ_ROWS):
                    j = min(i + READ_ROWS, docs.size)
                    at, doc = starts.read(i, j + 1).astype(np.int64), docs.read(i, j)
                    yield pa.RecordBatch.from_pydict({
                        "id": pa.array(doc, pa.int64(), mask=doc == NULL_ID), "start": pa.array(at[:-1]),
                        "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array(checksums(ids, at - base), pa.int64())})

    return (parts.select("part", "dtype").repartition(max(1, parts.count()), "part")
            .mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long"))

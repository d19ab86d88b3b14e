"""Token ids as Arrow stream files of fixed-size lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.llm.common import parts_for, shared_dir, small, stored, texts
from factorloom.llm.tokens import END_ID, coder, crc32, default_tokenizer, small_parts

SEQUENCE, BATCH = 2048, 64

_DOC = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])
_FILE = "part int, path string, n_docs long, n_ids long"


def _filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and the path in it; local files are mapped."""
    fs, top = pa.fs.FileSystem.from_uri(path)
    return (pa.fs.LocalFileSystem(use_mmap=True), top) if isinstance(fs, pa.fs.LocalFileSystem) else (fs, top)


class _Writer:
    """One stream of (ids, mask) rows of `sequence` elements and one of its documents' places.

    Both are written under names of the task attempt and renamed when complete,
    so an attempt that is lost or runs twice leaves whole files.
    """

    def __init__(self, folder: str, part: int, attempt: int, dtype: np.dtype, sequence: int, batch: int):
        self.fs, top = _filesystem(folder)
        self.names = [f"{top}/part-{part:06d}.{kind}.arrows" for kind in ("ids", "docs")]
        self.tries = [f"{x}.{attempt}" for x in self.names]
        self.sequence, self.rows, self.dtype = sequence, batch * sequence, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.outs = [self.fs.open_output_stream(x) for x in self.tries]
        self.ids, self.docs = pa.ipc.new_stream(self.outs[0], self.schema), pa.ipc.new_stream(self.outs[1], _DOC)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = self.n_docs = 0

    def _blocks(self, ids: np.ndarray) -> None:
        short = -len(ids) % self.sequence
        mask = np.ones(len(ids) + short, bool)
        mask[len(ids) :] = False
        values = (np.pad(ids, (0, short)), mask)
        self.ids.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(v), self.sequence) for v in values], schema=self.schema))

    def add(self, docs: list[int], ids: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in ids], "int64")
        ends = self.n_ids + np.cumsum(sizes)
        self.docs.write_batch(pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ends - sizes), pa.array(sizes)], schema=_DOC))
        self.waiting += ids
        self.n_waiting += int(sizes.sum())
        self.n_ids, self.n_docs = self.n_ids + int(sizes.sum()), self.n_docs + len(docs)
        if self.n_waiting >= self.rows:
            every = np.concatenate(self.waiting)
            whole = len(every) // self.rows * self.rows
            for i in range(0, whole, self.rows):
                self._blocks(every[i : i + self.rows])
            self.waiting, self.n_waiting = [every[whole:]], len(every) - whole

    def close(self) -> str:
        if self.n_waiting:
            self._blocks(np.concatenate(self.waiting))
        for w, out in ((self.ids, self.outs[0]), (self.docs, self.outs[1])):
            w.close()
            out.close()
        for a, b in zip(self.tries, self.names, strict=True):
            self.fs.move(a, b)
        return self.names[0]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, sequence: int = SEQUENCE, batch: int = BATCH) -> DataFrame:
    """Writes the documents' ids, in ascending doc_id order over all files, below `folder`; returns the files: part, path, n_docs, n_ids.

    Documents are dealt by ranges of doc_id and sorted within each; every range
    is one file of rows of `sequence` ids with a mask (false in the padding of the
    file's last row) and one file with the documents' places in it. A null text
    counts as empty and has the end id alone; rows repeated with their doc_id
    follow each other, by their texts, and rows without doc_id come first. An empty
    table gives no files; columns beyond doc_id and text are not read. Ids take 2
    bytes where the vocabulary allows it. There are as many files as shuffle
    partitions, or as 256 MB of text each ask for.
    """
    path = tokenizer or default_tokenizer()
    fs, top = _filesystem(folder)
    fs.create_dir(top, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, out, context = coder(path), None, TaskContext.get()
        for b in small_parts(batches):
            if out is None:
                out = _Writer(folder, context.partitionId(), context.taskAttemptId(), code.dtype, sequence, batch)
            if b.num_rows:
                out.add(b.column("doc_id").to_pylist(), code.encode_all(b.column("text").to_pylist()))
        if out is not None and out.n_docs:
            name = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([name]), pa.array([out.n_docs]), pa.array([out.n_ids])], ["part", "path", "n_docs", "n_ids"])

    ordered = texts(docs).repartitionByRange(parts_for(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(write, _FILE), "token-files")


class TokenFile:
    """Random access to one stream of (ids, mask) rows.

    All batches but the last have the same number of rows of one width, without
    nulls, and so the same size as messages: the offset of each is computed, and
    only the batch asked for is read. Of a local file that is mapped nothing is
    copied.
    """

    def __init__(self, fs: pa.fs.FileSystem, path: str):
        self.source = fs.open_input_file(path)
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(self.source))
        self.first = self.source.tell()
        self.size, self.end = 0, self.source.size()
        self.held, self.batch = 0, self._read(self.first)
        self.size = self.source.tell() - self.first
        self.rows = self.batch.num_rows
        self.sequence = self.schema.field("ids").type.list_size

    def _read(self, offset: int) -> pa.RecordBatch:
        if not self.first <= offset < self.end - 8:  # where the mark of the stream's end stands
            raise IndexError(offset)
        self.source.seek(offset)
        message = pa.ipc.read_message(self.source)
        return pa.ipc.read_record_batch(message, self.schema)

    def at(self, batch: int) -> pa.RecordBatch:
        if batch != self.held:
            self.batch, self.held = self._read(self.first + batch * self.size), batch
        return self.batch

    def row(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """ids (not copied) and mask of one row."""
        batch = self.at(row // self.rows)
        k = row % self.rows
        if k >= batch.num_rows:
            raise IndexError(row)
        return batch.column("ids")[k].values.to_numpy(), batch.column("mask")[k].values.to_numpy(zero_copy_only=False)

    def ids(self, first: int, n: int) -> np.ndarray:
        """The n ids from place `first` on; copied only where they go over several batches. Ids that the mask leaves out are an error."""
        width, parts = self.rows * self.sequence, []
        for k in range(first // width, (first + n - 1) // width + 1):
            batch, low, high = self.at(k), max(first - k * width, 0), min(first + n - k * width, width)
            if batch.column("mask").values[low:high].true_count != high - low:
                raise ValueError(f"ids {first} to {first + n} go beyond the mask")
            parts.append(batch.column("ids").values.to_numpy(zero_copy_only=True)[low:high])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read_documents(files: DataFrame, folder: str) -> DataFrame:
    """The documents that the files hold: part, doc_id, first (place in its file), n_tokens, ids_crc32. Each is looked up by its place; a file is read by one task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(folder)
        for b in batches:
            for part, name in zip(b.column("part").to_pylist(), b.column("path").to_pylist(), strict=True):
                held = TokenFile(fs, name)
                with fs.open_input_stream(name.replace(".ids.", ".docs.")) as docs:
                    for d in pa.ipc.open_stream(docs):
                        sums = []
                        for first, n in zip(d.column("first").to_pylist(), d.column("n_tokens").to_pylist(), strict=True):
                            ids = held.ids(first, n)
                            if ids[-1] != END_ID:
                                raise ValueError(f"{name}: a document lacks its end")
                            sums.append(crc32(ids))
                        yield pa.RecordBatch.from_arrays([pa.array([part] * d.num_rows, pa.int32()), d.column("doc_id"), d.column("first"), d.column("n_tokens"), pa.array(sums, pa.int64())], ["part", "doc_id", "first", "n_tokens", "ids_crc32"])

    n = max(files.count(), 1)
    return files.repartitionByRange(n, "part").mapInArrow(read, "part int, doc_id long, first long, n_tokens long, ids_crc32 long")


def sequence_at(folder: str, path: str, row: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and mask of one row of a file below `folder`, whose batch is found by its computed offset."""
    return TokenFile(_filesystem(folder)[0], path).row(row)


def token_files(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Writes the files and reads them back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Offsets are summed over the files, of which there are as many as shuffle
    partitions, not over documents.
    """
    spark: SparkSession = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    files = write_token_files(docs, folder, tokenizer)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = small(files.select("part", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)).alias("before")))
    return read_documents(files, folder).join(before, "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")

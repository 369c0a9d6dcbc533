"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds the ids of many documents as little-endian unsigned 32-bit integers. Whole documents are gathered into
frames; each frame is compressed by itself, so a reader decompresses only those that hold the documents asked for.
Layout: frames, then two skippable frames that any zstandard reader passes over: an index of the documents (itself a
compressed frame inside), and the seek table of the public seekable format: for each frame its compressed size, its
size and the low 32 bits of its XXH64, then the number of frames, a flag byte and the closing magic number.
Files are written through pyarrow's file systems into the folder that all executors share.
"""

from __future__ import annotations

import gc
import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from variorum.llm._shared import documents, materialize, scratch, slices, text_bytes
from variorum.llm.bpe import FURTHER, PieceEncoder, byte_letters, tokenizer_path

#: Bytes of ids in a frame, bytes of text for a file, bytes of text that are encoded together, id of the end token, pieces that a worker remembers.
FRAME, FILE, SLICE, END, MEMO = 1 << 18, 32 << 20, 8 << 20, 2, 600_000
#: Files whose ids are summed together, tasks that read at most.
STRIDE, READERS = 1000, 20_000
#: Fixed values of the public format.
SEEK_FRAME, INDEX_FRAME, SEEK_END = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
_TABLE = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
_DOCS = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("first", "<u4"), ("n", "<u4")])


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Spark writes file:/x where a URI has file:///x."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri else (pyarrow.fs.LocalFileSystem(), uri)


class Writer:
    """Writes documents one after another; a document may fill a frame of its own, however long it is."""

    def __init__(self, sink, frame: int = FRAME, level: int = 1) -> None:
        self.sink, self.frame, self.pack = sink, frame, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int, int]] = []
        self.held: list[bytes] = []
        self.size = self.ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.frame:
            self._flush()
        self.docs.append((doc_id or 0, doc_id is not None, len(self.table), self.size // 4, len(ids) // 4))
        self.held.append(ids)
        self.size += len(ids)
        self.ids += len(ids) // 4

    def _flush(self) -> None:
        raw = b"".join(self.held)
        packed = self.pack.compress(raw)
        self.sink.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        index = self.pack.compress(np.array(self.docs, _DOCS).tobytes())
        self.sink.write(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        table = np.array(self.table, _TABLE).tobytes()
        self.sink.write(struct.pack("<II", SEEK_FRAME, len(table) + 9) + table + struct.pack("<IBI", len(self.table), 0x80, SEEK_END))


class Reader:
    """Reads the index at once, and only the frames of the documents asked for."""

    def __init__(self, source) -> None:
        self.source = source
        total = source.size()
        source.seek(total - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_END or flags != 0x80:
            raise ValueError("no seek table with checksums")
        source.seek(total - 9 - frames * _TABLE.itemsize)
        self.table = np.frombuffer(source.read(frames * _TABLE.itemsize), _TABLE)
        self.starts = np.concatenate(([0], np.cumsum(self.table["packed"].astype(np.int64))))
        source.seek(int(self.starts[-1]))
        kind, size = struct.unpack("<II", source.read(8))
        if kind != INDEX_FRAME:
            raise ValueError("no document index")
        self.unpack = zstandard.ZstdDecompressor()
        self.docs = np.frombuffer(self.unpack.decompress(source.read(size)), _DOCS)

    def frame(self, k: int) -> bytes:
        self.source.seek(int(self.starts[k]))
        raw = self.unpack.decompress(self.source.read(int(self.table["packed"][k])), max_output_size=int(self.table["size"][k]))
        if len(raw) != self.table["size"][k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table["check"][k]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def read(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) in the file's order; of all documents, or of those with the given ids."""
        rows = self.docs if wanted is None else self.docs[np.isin(self.docs["doc_id"], list(wanted)) & (self.docs["known"] == 1)]
        held, raw = -1, b""
        for doc_id, known, frame, first, n in rows.tolist():
            if frame != held:
                held, raw = frame, self.frame(frame)
            yield doc_id if known else None, raw[4 * first : 4 * (first + n)]


class LibraryEncoder(PieceEncoder):
    """The tokenizers library's ids. Text is handed to the library's own splitter and model in pieces that begin where words
    begin, each distinct piece once while it is remembered, since most of a corpus is repeated words."""

    def __init__(self, source: bytes, memo: int = MEMO) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(source.decode())
        if library.normalizer is not None or not isinstance(library.pre_tokenizer, ByteLevel):
            raise ValueError("only byte-level tokenizers without a normalizer are supported")
        super().__init__(memo, [t.content for t in library.get_added_tokens_decoder().values()])
        self.library, self.split, self.model = library, library.pre_tokenizer.pre_tokenize_str, library.model.tokenize
        self.words: dict[str, bytes] = {}
        self.letters = {b: letter for letter, b in byte_letters().items()}

    def special_id(self, token: str) -> int:
        return self.library.token_to_id(token)

    def new(self, parts: list[str]) -> Iterator[bytes]:
        model, split, letters = self.model, self.split, self.letters
        words = self.words
        for part in parts:
            if part[1:].isalpha() and part[0] == " " and (part.isascii() or max(part) < FURTHER):
                yield pack([t.id for t in model("\u0120" + part[1:] if part.isascii() else part.encode().decode("latin-1").translate(letters))])
                continue
            ids = b""
            for word, _ in split(part):
                known = words.get(word)
                if known is None:
                    if len(words) >= 50_000:
                        words.clear()
                    known = words[word] = pack([t.id for t in model(word)])
                ids += known
            yield ids


_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def pack(ids: list[int]) -> bytes:
    """Little-endian, 32 bits each."""
    return _PACK[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[bytes, LibraryEncoder] = {}


def _encoder(source: bytes) -> LibraryEncoder:
    if source not in _encoders:
        _encoders.clear()
        _encoders[source] = LibraryEncoder(source)
    return _encoders[source]


def write_token_files(docs: DataFrame, folder: str | None = None, *, tokenizer: str | None = None, end: int = END, per_file: int = FILE) -> DataFrame:
    """Write docs in ascending doc_id order into files of about ``per_file`` bytes of text, and return (file, path, docs, ids).

    A null text is the empty text, of which only the end token is written; null ids come first; rows that share an id
    come in the order of a hash of their texts, and may be in several files. An empty table makes no file. Each file is written under another name
    and then renamed, so a task that is run again, or twice, leaves one whole file.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    with open(tokenizer or tokenizer_path(), "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    files = max(1, -(-text_bytes(rows) // per_file))
    closing = np.array([end], "<u4").tobytes()
    schema = pa.schema([("file", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = slices(batches, "text", SLICE)
        if (first := next(batches, None)) is None:
            return
        gc.disable()  # millions of small objects, none in a cycle
        encoder, task = _encoder(shared.value), TaskContext.get()
        files, base = file_system(folder)
        files.create_dir(base, recursive=True)
        k = task.partitionId()
        own, final = f"{base}/.{k}-{task.taskAttemptId()}", f"tokens-{k:06d}.zst"
        with files.open_output_stream(own) as sink:
            writer = Writer(sink)
            while first is not None:
                for doc_id, ids in zip(first.column("doc_id").to_pylist(), encoder.encode(first.column("text"))):
                    writer.add(doc_id, ids + closing)
                first = next(batches, None)
            writer.close()
        files.move(own, f"{base}/{final}")
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([f"{folder}/{final}"]), pa.array([len(writer.docs)], pa.int64()), pa.array([writer.ids], pa.int64())], schema=schema)

    # an id that many rows share, or have none of, is dealt by text, and rows alike in both at random
    order = rows.withColumns({"_text": F.xxhash64("text"), "_row": F.rand(END)})
    dealt = order.repartitionByRange(files, "doc_id", "_text", "_row").sortWithinPartitions("doc_id", "_text", "_row").drop("_text", "_row")
    return materialize(dealt.mapInArrow(write, "file int, path string, docs long, ids long"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, read back from the files.

    files: what ``write_token_files`` returns. Where a file starts is a running sum over ``STRIDE`` files at a time, and
    over the sums of those: no list of files comes to the driver. A document without text has its end token only, a
    null id stays null; without files the result is empty. A damaged frame raises an error.
    """
    group = (F.col("file") / STRIDE).cast("int")
    sums = files.groupBy(group.alias("_group")).agg(F.sum("ids").alias("_ids"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_group", F.coalesce(F.sum("_ids").over(before(Window.partitionBy(F.lit(0)).orderBy("_group"))), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("ids").over(before(Window.partitionBy("_group").orderBy("file"))), F.lit(0))
    todo = files.withColumn("_group", group).withColumn("_within", within).join(sums, "_group").select("file", "path", (F.col("_before") + F.col("_within")).alias("start"))
    todo = materialize(todo, "file-starts")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                files, name = file_system(path)
                with files.open_input_file(name) as source:
                    reader = Reader(source)
                    out = [(doc_id, len(ids) // 4, zlib.crc32(ids)) for doc_id, ids in reader.read()]
                ends = start + np.cumsum([n for _, n, _ in out])
                starts = np.concatenate(([start], ends[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array(starts, pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], schema=schema)

    rows = todo.repartitionByRange(max(1, min(todo.count(), READERS)), "file").select("path", "start")
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(documents(spark, sf_dir)))

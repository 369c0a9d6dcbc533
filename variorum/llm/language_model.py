"""Language-model scoring by deleted interpolation.

The model mixes maximum-likelihood estimates: P(w | v) = a * c(v, w) / c(v) + b * c(w) / N + c / (V + 1), where the weights
a, b, c depend on the bucket of the context's frequency c(v). The training documents are split in two; each half's
words, with estimates counted on the other half, are the held-out counts from which expectation-maximisation learns
the weights. Counts of all training documents then score every document.

No table of n-grams fits one machine, and a join of every word of the corpus with one would shuffle the corpus many times
over. So documents are read in chunks of about ``CHUNK`` words. A chunk leaves its words, as numbers, in a file in the
shared folder, and sends each distinct n-gram once, as a hash, to the bucket of that hash, where the counts of all
chunks meet. A bucket answers each chunk with the totals alone, in the order in which the chunk asked. With these and
its file a chunk yields the held-out statistics, and then its documents' scores. N-grams are told apart by 64-bit hashes.

A chunk has a row for each bucket, so both growing with the corpus would make rows by the square. Beyond ``FAN`` buckets the
exchange has levels: chunks ask at most ``FAN`` wide ranges of hashes; in each, groups of chunks are merged to one asker
that holds what a chunk holds, and asks the ranges below; its answer is dealt back to its chunks. So there are at most
FAN rows for a chunk on each level, and levels grow with the logarithm of the corpus.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.llm._shared import documents, is_held_out, materialize, scratch, slices, text_bytes
from variorum.llm.token_file import file_system

#: Words of a chunk; bytes of text whose n-grams a bucket holds, on average.
CHUNK, PER_BUCKET = 1_500_000, 12 << 20
#: Ranges that a chunk asks at most.
FAN = 256
#: Documents of this remainder of the id's crc32 are never learned from.
MODULUS, HELD_OUT = 7, 2
#: Buckets of a context's frequency (powers of two), rounds of expectation-maximisation, least weight.
BUCKETS, ROUNDS, LEAST = 40, 100, 1e-6
#: The end of a text, which can't be a word, and the hash of the mark before its first word, which is no text at all.
_END, _START = b"", xxhash.xxh64_intdigest(b"", 11)
_ROW = "chunk string, bucket int, words binary, word_counts binary, pairs binary, pair_counts binary"


def pack(a: np.ndarray) -> bytes:
    """Bytes of equal weight together, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(a.size, a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<QB", a.size, a.dtype.itemsize) + planes.tobytes())


def unpack(raw: bytes, dtype: str) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n, width = struct.unpack_from("<QB", raw)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=9).reshape(width, n).T).view(dtype).reshape(-1)


def pack_rising(a: np.ndarray) -> bytes:
    first = np.concatenate((a[:1], np.diff(a))) if len(a) else a
    return pack(first)


def unpack_rising(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, "<u8"), dtype=np.uint64)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a pair from its hashes."""
    h = a * np.uint64(0x9E3779B185EBCA87) ^ (b << np.uint64(31) | b >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x165667B19E3779F9)
    return h ^ h >> np.uint64(32)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the hash, so that hashes in order are in the order of their buckets."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class _Numbers(dict):
    """Numbers words in the order in which they are looked up."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Chunk:
    """Documents' words as numbers, in the order of the words' hashes."""

    def __init__(self) -> None:
        self.place = _Numbers({_END: 0, None: 1})
        self.words: list[np.ndarray] = []
        self.docs: list[tuple[int, int, int, int, int]] = []  # id, known, held out, half, words with the end
        self.size = 0

    def add(self, doc_id: int | None, held_out: bool, half: int, text: str) -> None:
        found = text.encode("utf-8", "surrogatepass").lower().split()
        n = len(found) + 1
        ids = np.zeros(n, np.int32)
        ids[:-1] = np.fromiter(map(self.place.__getitem__, found), np.int32, n - 1)
        self.words.append(ids)
        self.docs.append((doc_id or 0, doc_id is not None, held_out, half, n))
        self.size += n

    def close(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the distinct words in order, each token's number among them, and the documents."""
        hashes = np.fromiter((_START if w is None else xxhash.xxh64_intdigest(w, 7) for w in self.place), np.uint64, len(self.place))
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        return hashes[order], rank[np.concatenate(self.words)], np.array(self.docs, DOCS)


DOCS = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("held_out", "u1"), ("half", "u1"), ("n", "<u4")])


def contexts(hashes: np.ndarray, tokens: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The word before each token, the start before a document's first."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    ends = np.cumsum(docs["n"].astype(np.int64))
    before[ends - docs["n"]] = np.searchsorted(hashes, np.uint64(_START))
    return before


def distinct_pairs(hashes: np.ndarray, before: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct pairs in order, each token's number among them, and the pairs as context * words + word."""
    key = before.astype(np.int64) * len(hashes) + tokens
    pairs, inverse = np.unique(key, return_inverse=True)
    h = mix(hashes[pairs // len(hashes)], hashes[pairs % len(hashes)])
    order = np.argsort(h, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return h[order], rank[inverse], pairs[order]


def halves(number: np.ndarray, size: int, half: np.ndarray) -> np.ndarray:
    """Counts in each half of the training documents; half is 2 for a document that isn't learned from."""
    return np.stack([np.bincount(number[half == k], minlength=size) for k in (0, 1)], axis=1).astype(np.uint32)


def _read(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    files, name = file_system(path)
    with files.open_input_file(name) as source:
        raw = source.read()
    sizes = struct.unpack_from("<3Q", raw)
    at, parts = 24, []
    for n in sizes:
        parts.append(raw[at : at + n])
        at += n
    docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(parts[2]), DOCS)
    return unpack_rising(parts[0]), unpack(parts[1], "<i4"), docs


def _write(path: str, hashes: np.ndarray, tokens: np.ndarray, docs: np.ndarray) -> None:
    parts = [pack_rising(hashes), pack(tokens), zstandard.ZstdCompressor(level=1).compress(docs.tobytes())]
    files, name = file_system(path)
    own = f"{name}.{TaskContext.get().taskAttemptId()}"
    with files.open_output_stream(own) as sink:
        sink.write(struct.pack("<3Q", *map(len, parts)) + b"".join(parts))
    files.move(own, name)


def ask(docs: DataFrame, folder: str, buckets: int, chunk_words: int = CHUNK) -> DataFrame:
    """Write each chunk's file; a row for each chunk and bucket with the hashes of its n-grams there and their counts."""

    def rows(chunk: Chunk, name: str) -> Iterator[pa.RecordBatch]:
        hashes, tokens, docs = chunk.close()
        _write(f"{folder}/{name}", hashes, tokens, docs)
        before = contexts(hashes, tokens, docs)
        half = np.repeat(np.where(docs["held_out"] == 1, 2, docs["half"]), docs["n"])
        pair_hashes, numbers, _ = distinct_pairs(hashes, before, tokens)
        word_counts = halves(tokens, len(hashes), half)
        start = np.searchsorted(hashes, np.uint64(_START))
        first = np.where(docs["held_out"] == 1, 2, docs["half"])
        word_counts[start] = [(first == 0).sum(), (first == 1).sum()]
        pair_counts = halves(numbers, len(pair_hashes), half)
        for values in _dealt(name, hashes, word_counts, pair_hashes, pair_counts, buckets):
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _ASKED)], schema=_ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(folder)
        files.create_dir(base, recursive=True)
        chunk, k, part = Chunk(), 0, TaskContext.get().partitionId()
        for batch in slices(batches, "text"):
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "held_out", "half", "text"))
            for doc_id, held_out, half, text in zip(*columns):
                chunk.add(doc_id, held_out, half, text or "")
                if chunk.size >= chunk_words:
                    yield from rows(chunk, f"chunk-{part}-{k}")
                    chunk, k = Chunk(), k + 1
        if chunk.docs:
            yield from rows(chunk, f"chunk-{part}-{k}")

    half = F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(2)).cast("int")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id"), MODULUS, HELD_OUT).alias("held_out"), half.alias("half"), "text")
    return known.mapInArrow(run, _ROW)


def _pack_counts(counts: np.ndarray) -> bytes:
    return pack(counts.astype("<u4" if counts.size == 0 or counts.max() < 1 << 32 else "<u8"))


def _merged(table: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of all rows in order, each asked one's number among them, where rows begin, and the sums of counts."""
    hashes = [unpack_rising(x) for x in table.column(f"{kind}s").to_pylist()]
    keys, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    both = np.concatenate([_counts(x) for x in table.column(f"{kind}_counts").to_pylist()]).astype(np.float64)
    sums = np.stack([np.bincount(inverse, both[:, k], len(keys)) for k in (0, 1)], axis=1).astype(np.uint64)
    return keys, inverse, np.cumsum([0, *map(len, hashes)]), sums


_ASKED = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("words", "word_counts", "pairs", "pair_counts"))])


def _dealt(name: str, words: np.ndarray, word_counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, buckets: int) -> Iterator[list]:
    """A row of _ASKED for each bucket that some of the hashes, which rise, fall in."""
    wide, narrow = bucket_of(words, buckets), bucket_of(pairs, buckets)
    some = np.union1d(wide, narrow)
    w, p = (np.searchsorted(x, some) for x in (wide, narrow))
    w_end, p_end = (np.searchsorted(x, some, side="right") for x in (wide, narrow))
    for k, b in enumerate(some.tolist()):
        mine, two = slice(w[k], w_end[k]), slice(p[k], p_end[k])
        yield [name, b, pack_rising(words[mine]), _pack_counts(word_counts[mine]), pack_rising(pairs[two]), _pack_counts(pair_counts[two])]


def levels(buckets: int, fan: int = FAN) -> list[int]:
    """How many ranges each level has: powers of one number of at most ``fan``, the last at least ``buckets``."""
    depth = 1
    while fan**depth < buckets:
        depth += 1
    width = next(w for w in range(1, fan + 1) if w**depth >= buckets)
    return [width ** (k + 1) for k in range(depth)]


def exchange(asked: DataFrame, ranges: list[int]) -> DataFrame:
    """(chunk, bucket, words, pairs) for rows that ask the first of ``ranges``: totals, as ``answer`` gives them on the last level."""
    if len(ranges) == 1:
        return answer(asked)
    groups, below = -(-ranges[-1] // ranges[0]), ranges[1]
    asked = materialize(asked.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int")), "asked")
    def merge(table: pa.Table) -> pa.Table:
        name = f"{table.column('bucket')[0].as_py()}-{table.column('part')[0].as_py()}"
        (words, _, _, word_counts), (pairs, _, _, pair_counts) = _merged(table, "word"), _merged(table, "pair")
        return pa.Table.from_pylist([dict(zip(_ASKED.names, row)) for row in _dealt(name, words, word_counts, pairs, pair_counts, below)], schema=_ASKED)

    answers = materialize(exchange(asked.groupBy("bucket", "part").applyInArrow(merge, _ROW), ranges[1:]), "answers")
    place = F.split("chunk", "-")
    told = collected(answers).select(place[0].cast("int").alias("bucket"), place[1].cast("int").alias("part"), F.col("words").alias("all_words"), F.col("pairs").alias("all_pairs"))

    def deal(asked: pa.Table, told: pa.Table) -> pa.Table:
        out = {"chunk": asked.column("chunk"), "bucket": asked.column("bucket")}
        for kind in ("word", "pair"):
            _, inverse, ask, _ = _merged(asked, kind)
            sums = _counts(told.column(f"all_{kind}s")[0].as_py())
            out[f"{kind}s"] = pa.array([_pack_counts(sums[inverse[i:j]]) for i, j in zip(ask, ask[1:])], pa.binary())
        return pa.table(out)

    back = asked.groupBy("bucket", "part").cogroup(told.groupBy("bucket", "part")).applyInArrow(deal, "chunk string, bucket int, words binary, pairs binary")
    return back.unionByName(answers.filter("chunk = ''"))


def answer(asked: DataFrame) -> DataFrame:
    """For each chunk and bucket the totals of the n-grams asked for; and for each bucket, with an empty chunk, its totals:
    words in either half, distinct words in training."""
    def total(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        chunks = table.column("chunk").to_pylist()
        out = {"chunk": chunks + [""], "bucket": [bucket] * (len(chunks) + 1)}
        for kind in ("word", "pair"):
            keys, inverse, ask, sums = _merged(table, kind)
            told = [_pack_counts(sums[inverse[i:j]]) for i, j in zip(ask, ask[1:])]
            if kind == "word":
                word = keys != np.uint64(_START)
                size = [*sums[word].sum(axis=0).tolist(), int((sums[word].sum(axis=1) > 0).sum())]
                out["words"] = told + [struct.pack("<3Q", *size)]
            else:
                out["pairs"] = told + [b""]
        schema = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("words", pa.binary()), ("pairs", pa.binary())])
        return pa.table([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return asked.groupBy("bucket").applyInArrow(total, "chunk string, bucket int, words binary, pairs binary")


def _counts(raw: bytes) -> np.ndarray:
    width = struct.unpack_from("<QB", zstandard.ZstdDecompressor().decompress(raw))[1]
    return unpack(raw, f"<u{width}").reshape(-1, 2).astype(np.int64)


def collected(answers: DataFrame) -> DataFrame:
    """(chunk, words, pairs): each chunk's totals in the order of its n-grams."""

    def gather(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("bucket").to_numpy())
        out = {"chunk": [table.column("chunk")[0].as_py()]}
        for kind in ("words", "pairs"):
            raw = table.column(kind).to_pylist()
            parts = [_counts(raw[k]) for k in order]
            out[kind] = [pack(np.concatenate(parts).astype("<u8"))]
        return pa.table(out)

    return answers.filter("chunk <> ''").groupBy("chunk").applyInArrow(gather, "chunk string, words binary, pairs binary")


def _bucket(c: np.ndarray) -> np.ndarray:
    """0 for a context that wasn't seen, then by powers of two."""
    return np.minimum(np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def held_out_statistics(chunks: DataFrame, folder: str, n: list[int], v: int) -> DataFrame:
    """(cell, n, p2, p1): words of each half whose estimates on the other half fall in one cell, and the sums of those.

    A cell is the context's bucket and the estimates' powers of two, relative to the uniform one: their number is bounded.
    """
    uniform = 1 / (v + 1)
    schema = pa.schema([("cell", pa.int64()), ("n", pa.float64()), ("p2", pa.float64()), ("p1", pa.float64())])

    def level(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.clip(np.floor(np.log2(np.maximum(p, 1e-300) / uniform)) + 16, 1, 63), 0).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, tokens, docs = _read(f"{folder}/{row['chunk']}")
                _, numbers, pairs = distinct_pairs(hashes, contexts(hashes, tokens, docs), tokens)
                half = np.repeat(np.where(docs["held_out"] == 1, 2, docs["half"]), docs["n"])
                own = halves(numbers, len(pairs), half)
                words, counts = _counts(row["words"]), _counts(row["pairs"])
                context, word = pairs // len(hashes), pairs % len(hashes)
                for k in (0, 1):
                    seen = own[:, k] > 0
                    c = words[context[seen], 1 - k]
                    p2 = np.where(c > 0, counts[seen, 1 - k] / np.maximum(c, 1), 0.0)
                    p1 = words[word[seen], 1 - k] / max(1, n[1 - k])
                    cell = (_bucket(c) * 64 + level(p2)) * 64 + level(p1)
                    weight = own[seen, k].astype(np.float64)
                    keys, inverse = np.unique(cell, return_inverse=True)
                    sums = [np.bincount(inverse, x, len(keys)) for x in (weight, weight * p2, weight * p1)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, sums)], schema=schema)

    cells = chunks.mapInArrow(run, "cell long, n double, p2 double, p1 double")
    return cells.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "p2", "p1")])


def learn_weights(cells: list[tuple[int, float, float, float]], v: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of pair, word and uniform estimate for each bucket of contexts, by expectation-maximisation.

    A bucket without held-out words takes those of the bucket below it; the first, where no context was seen, gives the
    pair estimate no weight.
    """
    out = np.zeros((BUCKETS, 3))
    cells = np.array(sorted(cells), np.float64).reshape(-1, 4)
    bucket = cells[:, 0].astype(np.int64) // 4096
    known = np.array([0.0, 0.0, 1.0])
    for b in range(BUCKETS):
        own = cells[bucket == b]
        if len(own):
            n = own[:, 1]
            p = np.stack([own[:, 2] / n, own[:, 3] / n, np.full(len(own), 1 / (v + 1))], axis=1)
            w = np.array([0.0, 0.5, 0.5]) if b == 0 else np.full(3, 1 / 3)
            for _ in range(rounds):
                share = p * w
                share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
                w = (n[:, None] * share).sum(axis=0) / n.sum()
            w = np.maximum(w, [0.0 if b == 0 else LEAST, LEAST, LEAST])
            known = w / w.sum()
        out[b] = known
    return out


def text_scores(docs: DataFrame, *, chunk_words: int = CHUNK, per_bucket: int = PER_BUCKET, fan: int = FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Words are what stands between blank and tab to carriage return, lower-cased in A-Z; a text's end counts as a word, so a
    null or empty text has one. Texts are read whole, repeated rows count and are scored each, and a null id isn't held
    out. An empty table gives an empty result; without training words all estimates are uniform. Other columns of
    docs are not read.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "chunks")
    ranges = levels(max(1, -(-text_bytes(docs) // per_bucket)), fan)
    answers = materialize(exchange(ask(docs.select("doc_id", "text"), folder, ranges[0], chunk_words), ranges), "totals")
    n_a, n_b, v = _sum_totals(answers.filter("chunk = ''").select("words"))
    chunks = materialize(collected(answers), "chunk-totals")
    cells = [tuple(r) for r in held_out_statistics(chunks, folder, [n_a, n_b], v).collect()]  # at most BUCKETS * 4096
    weights = learn_weights(cells, v)
    n = n_a + n_b
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, tokens, docs = _read(f"{folder}/{row['chunk']}")
                _, numbers, pairs = distinct_pairs(hashes, contexts(hashes, tokens, docs), tokens)
                words, counts = _counts(row["words"]).sum(axis=1), _counts(row["pairs"]).sum(axis=1)
                context, word = pairs // len(hashes), pairs % len(hashes)
                c, w = words[context], weights[_bucket(words[context])]
                p = w[:, 0] * (counts / np.maximum(c, 1)) + w[:, 1] * (words[word] / max(1, n)) + w[:, 2] / (v + 1)
                first = np.cumsum(docs["n"].astype(np.int64)) - docs["n"]
                base = np.add.reduceat(np.log10((words + 1) / (n + v + 1))[tokens], first)
                score = np.add.reduceat(np.log10(p)[numbers], first)
                known = np.add.reduceat((words > 0).astype(np.int64)[tokens], first)
                ids = pa.array(docs["doc_id"].astype(np.int64), mask=docs["known"] == 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(docs["held_out"] == 1), pa.array(docs["n"].astype(np.int64)), pa.array(known), pa.array(np.full(len(docs), n, np.int64)), pa.array(base), pa.array(score)], schema=schema)

    return chunks.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _sum_totals(totals: DataFrame) -> tuple[int, int, int]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("words").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in struct.unpack("<3Q", raw)], names=["a", "b", "v"])

    row = totals.mapInArrow(add, "a long, b long, v long").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in "abv"]).first()
    return row[0], row[1], row[2]


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_scores(documents(spark, sf_dir))

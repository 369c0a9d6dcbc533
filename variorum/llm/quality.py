"""Quality classifier: a convolutional network over bytes, in numpy.

A document's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by ``CHUNK - STEP`` and cover all of it.
Learned filters of eight bytes run over each chunk at every fourth byte; each filter's largest and mean value in the
chunk go through a hidden layer, the hidden units' largest and mean values over all chunks through the last one, to
one probability. The network is fitted by Adam on the driver, on a bounded sample of labelled rows (``SAMPLE``), and
scores every document on the executors, a bounded number of bytes at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.llm._shared import documents, hash_sample, is_held_out, slices, tidy

#: Bytes of a chunk, of its step; bytes between two places of a filter.
CHUNK, STEP, STRIDE = 256, 192, 4
#: Numbers for a byte, filters, hidden units.
WIDTH, FILTERS, HIDDEN = 8, 32, 24
#: The bounded sample: labelled rows of each label at most, characters of a text in it at most, parts that a longer text gives.
SAMPLE, LONGEST_SAMPLE, PARTS = 1500, 32_768, 16
#: Rounds over the sample, texts of a step, chunks that a text gives to a step at most (drawn anew each time).
EPOCHS, BATCH, DRAWN, RATE, SEED = 8, 32, 32, 4e-3, 20
THRESHOLD = 0.7
#: Labels of this remainder of the id's crc32 are never learned from.
MODULUS, HELD_OUT = 4, 2


def chunks(raw: bytes) -> np.ndarray:
    """Rows of CHUNK bytes, zeros after the end; an empty text has one row of zeros."""
    n = max(1, -(-max(0, len(raw) - (CHUNK - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


class Network:
    def __init__(self, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        k = STRIDE * WIDTH
        self.p = {
            "byte": r.normal(0, 0.5, (256, WIDTH)).astype(np.float32),
            "left": r.normal(0, (1 / k) ** 0.5, (k, FILTERS)).astype(np.float32),
            "right": r.normal(0, (1 / k) ** 0.5, (k, FILTERS)).astype(np.float32),
            "filter": np.zeros(FILTERS, np.float32),
            "hidden": r.normal(0, (1 / FILTERS) ** 0.5, (2 * FILTERS, HIDDEN)).astype(np.float32),
            "unit": np.zeros(HIDDEN, np.float32),
            "out": r.normal(0, (1 / HIDDEN) ** 0.5, 2 * HIDDEN).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }

    def _filters(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.p["byte"][rows].reshape(len(rows) * (CHUNK // STRIDE), STRIDE * WIDTH)
        a = (x @ self.p["left"]).reshape(len(rows), CHUNK // STRIDE, FILTERS)
        b = (x @ self.p["right"]).reshape(len(rows), CHUNK // STRIDE, FILTERS)
        z = a[:, :-1] + b[:, 1:]
        z += self.p["filter"]
        return x, np.maximum(z, 0, out=z)

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """Hidden units of each chunk."""
        z = self._filters(rows)[1]
        f = np.concatenate([z.max(axis=1), z.mean(axis=1)], axis=1)
        return np.maximum(f @ self.p["hidden"] + self.p["unit"], 0)

    def combined(self, hidden: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of each document, whose chunks begin at ``first``."""
        n = np.diff(np.append(first, len(hidden)))
        d = np.concatenate([np.maximum.reduceat(hidden, first), np.add.reduceat(hidden, first) / n[:, None]], axis=1)
        return 1 / (1 + np.exp(-np.clip(d @ self.p["out"] + self.p["bias"], -30, 30)))

    def score(self, batch: list[bytes], block: int = 1024) -> np.ndarray:
        """Any number of chunks, a block of them in memory at a time."""
        parts, hidden, held = [], [], 0
        first = []
        total = 0
        for raw in batch:
            rows = chunks(raw)
            first.append(total)
            total += len(rows)
            for k in range(0, len(rows), block):
                parts.append(rows[k : k + block])
                held += len(parts[-1])
                if held >= block:
                    hidden.append(self.pooled(np.concatenate(parts)))
                    parts, held = [], 0
        if parts:
            hidden.append(self.pooled(np.concatenate(parts)))
        return self.combined(np.concatenate(hidden), np.array(first)) if batch else np.zeros(0)

    def gradients(self, rows: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, z = self._filters(rows)
        top = z.argmax(axis=1)
        f = np.concatenate([z.max(axis=1), z.mean(axis=1)], axis=1)
        h = np.maximum(f @ p["hidden"] + p["unit"], 0)
        n = np.diff(np.append(first, len(h)))
        peak = np.maximum.reduceat(h, first)
        d = np.concatenate([peak, np.add.reduceat(h, first) / n[:, None]], axis=1)
        y = 1 / (1 + np.exp(-np.clip(d @ p["out"] + p["bias"], -30, 30)))
        e = ((y - label) * weight / len(label)).astype(np.float32)
        g = {"out": d.T @ e, "bias": e.sum(keepdims=True)}
        up = e[:, None] * p["out"]
        of = np.repeat(np.arange(len(first)), n)
        at = h == peak[of]
        share = np.maximum(np.add.reduceat(at.astype(np.float32), first), 1)
        dh = (up[of, :HIDDEN] * at / share[of] + up[of, HIDDEN:] / n[of, None]) * (h > 0)
        g["hidden"], g["unit"] = f.T @ dh, dh.sum(axis=0)
        df = dh @ p["hidden"].T
        dz = np.repeat((df[:, FILTERS:] / z.shape[1])[:, None, :], z.shape[1], axis=1)
        c, k = np.meshgrid(np.arange(len(rows)), np.arange(FILTERS), indexing="ij")
        dz[c, top, k] += df[:, :FILTERS]
        dz *= z > 0
        g["filter"] = dz.sum(axis=(0, 1))
        places = CHUNK // STRIDE
        zero = np.zeros((len(rows), 1, FILTERS), np.float32)
        da = np.concatenate([dz, zero], axis=1).reshape(-1, FILTERS)
        db = np.concatenate([zero, dz], axis=1).reshape(-1, FILTERS)
        g["left"], g["right"] = x.T @ da, x.T @ db
        dx = (da @ p["left"].T + db @ p["right"].T).reshape(len(rows) * places * STRIDE, WIDTH)
        flat = rows.reshape(-1)
        g["byte"] = np.stack([np.bincount(flat, dx[:, k], 256) for k in range(WIDTH)], axis=1)
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
        """Both labels count alike in all; documents are drawn in a seeded order."""
        r = np.random.default_rng(seed)
        label = np.asarray(labels, np.float32)
        weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9)).astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, steps = 0, epochs * -(-len(texts) // BATCH)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                rows = [chunks(texts[i]) for i in pick]
                rows = [x if len(x) <= DRAWN else x[np.sort(r.choice(len(x), DRAWN, replace=False))] for x in rows]
                first = np.cumsum([0, *map(len, rows[:-1])])
                g = self.gradients(np.concatenate(rows), first, label[pick], weight[pick])
                step += 1
                rate = RATE * (1 - step / (steps + 1))
                for k, x in g.items():
                    m[k] += 0.1 * (x - m[k])
                    v[k] += 0.001 * (x * x - v[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        return self


class Constant:
    """Where the labels hold one class only, or none: the share of label 1, one of each added."""

    def __init__(self, ones: int, zeros: int) -> None:
        self.share = (ones + 1) / (ones + zeros + 2)

    def score(self, batch: list[bytes]) -> np.ndarray:
        return np.full(len(batch), self.share)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: int = SAMPLE, longest: int = LONGEST_SAMPLE) -> list[tuple[str, int]]:
    """(text, label) of at most ``most`` ids of either label, the first in the order of a hash of the ids.

    Neither held-out ids nor null labels are taken, nor ids that have both labels. Where rows share an id, one of their
    texts is taken, that of the least hash. A text of more than ``longest`` characters gives ``PARTS`` parts of it, evenly
    spread. So at most 2 * most rows of longest characters come to the driver, whatever the tables hold.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).filter(~is_held_out(F.col("_id"), modulus, held_out) & F.col("_label").isin(0, 1))
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other")).filter("_id is not null and _label = _other").drop("_other")
    sizes = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    picked = [r for y in (1, 0) for r in hash_sample(known.filter(F.col("_label") == y), ["_id"], sizes.get(y, 0), most)]
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in picked], known.schema)
    text, part = F.coalesce("text", F.lit("")), longest // PARTS
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.substring("_text", (k * (F.char_length("_text") - part) / (PARTS - 1)).cast("int") + 1, F.lit(part))), "")
    found = docs.select(F.col("doc_id").alias("_id"), text.alias("_text")).join(F.broadcast(chosen), "_id")
    found = found.select("_id", "_label", F.struct(F.xxhash64("_text").alias("h"), F.when(F.char_length("_text") > longest, spread).otherwise(F.col("_text")).alias("text")).alias("_one"))
    rows = found.groupBy("_id").agg(F.min("_label").alias("_label"), F.min("_one").alias("_one")).collect()
    return [(r["_one"]["text"], r["_label"]) for r in sorted(rows, key=lambda r: r["_id"])]


def train(docs: DataFrame, labels: DataFrame) -> Network | Constant:
    rows = labelled_sample(docs, labels, "quality", MODULUS, HELD_OUT)
    ones = sum(y for _, y in rows)
    if not 0 < ones < len(rows):
        return Constant(ones, len(rows) - ones)
    return Network().fit([t.encode("utf-8", "surrogatepass") for t, _ in rows], np.array([y for _, y in rows]))


def score_texts(docs: DataFrame, model, modulus: int, held_out: int, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; text is all that a score is made of."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        for batch in slices(batches, "text"):
            score = np.asarray(model.score([(x or "").encode("utf-8", "surrogatepass") for x in batch.column("text").to_pylist()]), np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id"), modulus, held_out).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    A null text scores as the empty text, which is one chunk of zeros; very long texts are scored whole. A null id isn't
    held out. Repeated rows score alike; an id with both labels isn't learned from; an empty table gives an empty result;
    without labels of both kinds every document scores the share of label 1. Other columns of docs are not read.
    """
    return score_texts(docs, train(docs, labels), MODULUS, HELD_OUT)


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score below THRESHOLD; all columns as they were, and nothing is shuffled.

    A null text scores as the empty text; rows with null or repeated ids are each judged by their text, so equal texts go or stay
    together. An empty table gives an empty result. Without both labels nothing can be told and all rows stay.
    """
    model = train(docs, labels)
    if isinstance(model, Constant):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        for batch in slices(batches, "text"):
            score = np.asarray(model.score([(x or "").encode("utf-8", "surrogatepass") for x in batch.column("text").to_pylist()]))
            yield batch.filter(pa.array(score >= THRESHOLD))
            del batch
        tidy()

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))

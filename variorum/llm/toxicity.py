"""Toxicity by compression distance.

Two zstandard dictionaries are trained from a bounded sample of labelled rows: one on windows of ordinary text, one on
windows of toxic text. A window is one word between blanks (a longer word has several, which overlap), followed by a
fixed carrier text that both dictionaries hold, since zstandard leaves the last bytes of its input unmatched. A window's
evidence is the length it compresses to with the ordinary dictionary less that with the toxic one; most are below zero.

A toxic text is mostly ordinary words, and a dictionary trained on all of it holds what the ordinary one holds. So the
toxic dictionary's training windows are those of toxic sample texts whose word is tied to them by a likelihood-ratio
test (``EVIDENCE``); what the dictionary then holds, and how long a window gets, is zstandard's doing. A document's counts
of windows at or above each of the thresholds are calibrated to a probability by logistic regression on sample rows
that took no part in making the dictionaries.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.llm._shared import documents, is_held_out
from variorum.llm.quality import Constant, labelled_sample, score_texts

#: Labels of this remainder of the id's crc32 are never learned from.
MODULUS, HELD_OUT = 3, 1
#: The bounded sample: labelled rows of each label at most.
SAMPLE = 2500
#: Bytes of the ordinary and the toxic dictionary's content, bytes of the carrier, of a window, and of its step where a word is longer.
ORDINARY, TOXIC, CARRIER, WINDOW, STEP = 15_000, 1024, 48, 64, 32
#: The least likelihood ratio of a toxic training window's word, the trainer's lengths of a segment and of its parts.
EVIDENCE, SEGMENT, PART = 25.0, 16, 6
#: Compression level; differences in length that are counted; words whose difference is remembered.
LEVEL, GAINS, MEMO = 6, range(-2, 10), 400_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str) -> list[bytes]:
    """Runs of letters and digits of the lower-cased text; every character beyond ASCII counts as a letter."""
    return _WORD.findall(text.lower().encode("utf-8", "surrogatepass"))


def likelihood_ratio(a: int, n: int, b: int, m: int) -> float:
    """Twice the log-likelihood that a of n and b of m texts hold a word gains by two shares in place of one; half a text added."""
    share = (a + b + 1) / (n + m + 2)
    return 2 * ((a + 0.5) * math.log((a + 0.5) / (n + 1) / share) + (b + 0.5) * math.log((b + 0.5) / (m + 1) / share))


def toxic_windows(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Windows of toxic texts whose word is tied to them; where no word is, those whose word no ordinary text has."""
    split = [words(t) for t in toxic]
    in_toxic = Counter(w for t in split for w in set(t))
    in_ordinary = Counter(w for t in ordinary for w in set(words(t)))
    n, m = len(toxic), len(ordinary)
    tied = {w for w, a in in_toxic.items() if a / max(1, n) > in_ordinary[w] / max(1, m) and likelihood_ratio(a, n, in_ordinary[w], m) >= EVIDENCE}
    tied = tied or {w for w in in_toxic if not in_ordinary[w]}
    return [window for t in split for w in t if w in tied for window in windows(w)]


def windows(word: bytes) -> list[bytes]:
    text = b" " + word + b" "
    return [text[at : at + WINDOW] for at in range(0, max(1, len(text) - STEP), STEP)]


def trained(samples: list[bytes], size: int, **how: int) -> bytes:
    """The content of a dictionary that zstandard trains on samples; the distinct samples where they are too few to train on."""
    try:
        raw = zstandard.train_dictionary(size + 2048, samples, **how).as_bytes()
    except zstandard.ZstdError:
        raw = b"".join(dict.fromkeys(samples)) * 2
    return raw[-min(size, len(raw) * 2 // 3) :] if raw else b""


class _Gains(dict):
    """Word to the largest difference of its windows, as its place among GAINS from 1; 0 below all."""

    def __init__(self, model: Toxicity) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        gain = self[word] = self.model.gain(word)
        return gain


class Toxicity:
    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.ordinary, self.toxic, self.carrier = ordinary, toxic, ordinary[-CARRIER:]
        self.weights = np.zeros(len(GAINS) + 2)
        self._made: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def _compressors(self) -> tuple:
        if self._made is None:
            kw = {"window_log": 18, "write_content_size": False, "write_checksum": False, "write_dict_id": False, "format": zstandard.FORMAT_ZSTD1_MAGICLESS}
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, **kw)
            made = []
            for content in (self.ordinary, self.toxic + self.carrier):
                dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                dictionary.precompute_compress(compression_params=params)
                made.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params).compress)
            self._made = (*made, _Gains(self))
        return self._made

    def difference(self, word: bytes) -> int:
        """By how many bytes the toxic dictionary compresses the word's windows shorter than the ordinary one, at most."""
        ordinary, toxic, _ = self._compressors()
        return max(len(ordinary(w + self.carrier)) - len(toxic(w + self.carrier)) for w in windows(word))

    def gain(self, word: bytes) -> int:
        return min(max(self.difference(word) - GAINS.start + 1, 0), len(GAINS))

    def features(self, batch: list[bytes]) -> np.ndarray:
        out = np.zeros((len(batch), len(GAINS) + 2))
        out[:, 0] = 1
        look = self._compressors()[2].__getitem__ if self.toxic and self.ordinary else None
        for row, raw in zip(out, batch):
            found = words(raw.decode("utf-8", "surrogatepass"))
            row[1] = math.log1p(len(found))
            if look:
                gains = bytes(map(look, found))
                counts = [gains.count(k) for k in range(1, len(GAINS) + 1)]
                row[2:] = np.log1p(np.cumsum(counts[::-1])[::-1])
        return out

    def calibrate(self, texts: list[bytes], labels: np.ndarray, weight: np.ndarray, rounds: int = 60) -> Toxicity:
        """Ridge logistic regression by Newton's method."""
        x, y = self.features(texts), np.asarray(labels, np.float64)
        ridge = np.diag([1e-4, 0.1, *[0.1] * len(GAINS)])
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        self.weights = w
        return self

    def score(self, batch: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(batch) @ self.weights, -30, 30)))


def ordinary_windows(texts: list[str], most: int = 30_000, seed: int = 3) -> list[bytes]:
    """Runs of ordinary words, ``most`` of them in a seeded order."""
    found = []
    for t in texts:
        raw = b" " + b" ".join(words(t)) + b" "
        found += [raw[k : k + WINDOW] for k in range(0, len(raw), WINDOW)]
    return [found[k] for k in np.random.default_rng(seed).permutation(len(found))[:most]]


def train(docs: DataFrame, labels: DataFrame) -> Toxicity | Constant:
    rows = labelled_sample(docs, labels, "toxic", MODULUS, HELD_OUT, SAMPLE)
    rows = sorted(dict(rows).items())  # each text once
    known = labels.filter(~is_held_out(F.col("doc_id"), MODULUS, HELD_OUT) & F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect()
    total = {r["toxic"]: r["count"] for r in known}
    ones = sum(y for _, y in rows)
    if not 0 < ones < len(rows):
        return Constant(total.get(1, 0), total.get(0, 0))
    part = [zlib.crc32(t.encode("utf-8", "surrogatepass")) % 5 for t, _ in rows]
    fit = [r for r, k in zip(rows, part) if k < 3]
    toxic, ordinary = [t for t, y in fit if y], [t for t, y in fit if not y]
    model = Toxicity(trained(toxic_windows(toxic, ordinary), TOXIC, k=SEGMENT, d=PART), trained(ordinary_windows(ordinary), ORDINARY))
    rest = [r for r, k in zip(rows, part) if k >= 3] or rows
    y = np.array([y for _, y in rest])
    weight = np.where(y == 1, total.get(1, 1) / max(1, ones), total.get(0, 1) / max(1, len(rows) - ones))
    return model.calibrate([t.encode("utf-8", "surrogatepass") for t, _ in rest], y, weight / weight.mean())


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    A null text scores as the empty text, which has no window; very long texts and words are scored whole. A null id isn't
    held out. Repeated rows score alike; an empty table gives an empty result; without labels of both kinds every
    document scores the share of label 1. Other columns of docs are not read.
    """
    return score_texts(docs, train(docs, labels), MODULUS, HELD_OUT)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))

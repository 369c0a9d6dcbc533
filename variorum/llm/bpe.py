"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Text is cut at every blank that follows a non-blank character: the tokenizer's own word pattern always cuts there,
so pieces can be encoded one by one. Piece frequencies are counted over all documents; the most frequent pieces are
compiled, with their ids, into a minimal acyclic automaton that shares suffixes. Its arcs carry numbers whose sum along
a path is the entry's ordinal in the table of id sequences. The file (a few MB, its size bound by ``lexicon`` entries of
at most ``LONGEST`` bytes) is broadcast, and each worker maps it into memory. Pieces that the lexicon lacks are merged
exactly: by numpy over whole batches, and with a heap where a word is very long.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from variorum.llm._shared import documents, materialize, slices, texts

#: Entries of the lexicon, bytes of its longest entry, pieces that a worker remembers, words that one partial count holds.
LEXICON, LONGEST, MEMO, PARTIAL = 1 << 17, 40, 300_000, 250_000
#: Bytes of text that are encoded together.
SLICE = 4 << 20
#: Fixed value: the word pattern of byte-level BPE.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The first character after the Latin blocks, whose categories no longer change.
FURTHER = "\u0250"
#: Signs that never join the letters before them in one word (an apostrophe may).
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_NONE = np.int64(1 << 40)
_BLANK_BEFORE_BLANK = re.compile(r"\s ")
_BLANK_BEFORE_BLANK_RE2 = r"[\s\v\x{1c}-\x{1f}\x{85}\pZ] "


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself where it prints in Latin-1, else the next unused one from U+0100."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and merge rules of a byte-level BPE in the tokenizers library's JSON format."""

    def __init__(self, source: bytes) -> None:
        spec = json.loads(source)
        model = spec["model"]
        if model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError("only plain byte-level BPE is supported")
        letters = byte_letters()
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.base = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.base[b] = vocab[letter]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pairs = {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(pairs)}
        self.words = regex.compile(WORDS)
        self.splitter = ByteLevel(add_prefix_space=False, use_regex=True)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], _NONE)

    def merge_block(self, words: list[bytes]) -> list[bytes]:
        """Ids of short words, all merged together: each round applies every word's best rule, leftmost first."""
        n, width = len(words), max(map(len, words))
        raw = np.zeros((n, width), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, n)
        inside = np.arange(width) < lengths[:, None]
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        ids = np.where(inside, self.base[raw], -1)
        ids = np.concatenate([ids, np.full((n, 2), -1)], axis=1)
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        live = np.arange(n)
        a, r = ids, ranks
        columns = np.arange(width + 2)
        while len(live):
            at = r.argmin(axis=1)
            row = np.arange(len(live))
            best = r[row, at]
            go = best < _NONE
            if not go.all():
                done = ~go
                ids[live[done]] = a[done]
                live, a, r, at, best = live[go], a[go], r[go], at[go], best[go]
                row = row[: len(live)]
                if not len(live):
                    break
            a[row, at] = self.merged[best]
            shift = columns + (columns > at[:, None])
            a = np.take_along_axis(a, np.minimum(shift, width + 1), axis=1)
            a[:, -1] = -1
            shift = columns[:-1] + (columns[:-1] > at[:, None])
            r = np.take_along_axis(r, np.minimum(shift, width), axis=1)
            r[:, -1] = _NONE
            r[row, at] = self.rank(a[row, at], a[row, at + 1])
            left = at > 0
            r[row[left], at[left] - 1] = self.rank(a[row[left], at[left] - 1], a[row[left], at[left]])
        ends = (np.cumsum((ids >= 0).sum(axis=1)) * 4).tolist()
        flat = ids[ids >= 0].astype("<u4").tobytes()
        return [flat[i:j] for i, j in zip([0, *ends], ends)]

    def merge_long(self, word: bytes) -> np.ndarray:
        ids = self.base[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        pairs, merged = self.pairs, self.merged
        heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (rank := pairs.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(merged[rank]), -1
            after[i] = k = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if (rank := pairs.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (rank, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (rank := pairs.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (rank, h, ids[h], ids[i]))
        return np.array([x for x in ids if x >= 0], "<u4")

    def merge(self, words: Iterable[bytes], block: int = 8192) -> dict[bytes, bytes]:
        """Little-endian ids of each word."""
        todo, out = sorted(set(words), key=len), {}
        first = 0
        while first < len(todo):
            last = min(len(todo), first + block)
            if len(todo[last - 1]) > 64:
                last = next((k for k in range(first, last) if len(todo[k]) > 64), last)
                if last == first:
                    out.update((w, self.merge_long(w).tobytes()) for w in todo[first:])
                    break
            if first == 0 and not todo[0]:
                out[b""] = b""
                first = 1
                continue
            out.update(zip(todo[first:last], self.merge_block(todo[first:last])))
            first = last
        return out

    def words_of(self, piece: str) -> list[bytes]:
        """Beyond Latin letters the library's own splitter decides, whose Unicode tables may be older or newer than regex's."""
        if piece.isascii() or max(piece) < FURTHER:
            if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
                return [piece.encode()]
            return [w.encode() for w in self.words.findall(piece)]
        return [piece[i:j].encode("utf-8", "surrogatepass") for _, (i, j) in self.splitter.pre_tokenize_str(piece)]

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        split = {p: self.words_of(p) for p in pieces}
        ids = self.merge(w for words in split.values() for w in words)
        return {p: ids[words[0]] if len(words) == 1 else b"".join(map(ids.__getitem__, words)) for p, words in split.items()}


def pieces(text: str) -> list[str]:
    """Parts of text at which words begin: the first as it is, each other without the one blank before it."""
    parts = text.split(" ")
    if not _BLANK_BEFORE_BLANK.search(text):
        return parts
    out = [parts[0]]
    for part in parts[1:]:
        # a blank is no cut at the start of the text or after another blank character
        if not out[-1] and len(out) > 1 or out[-1][-1:].isspace():
            out[-1] += " " + part
        else:
            out.append(part)
    return out


class Lexicon:
    """A minimal acyclic automaton over byte strings, in one buffer: header, arc keys (state << 8 | byte), arc targets, arc
    numbers, final flags, starts of id sequences, ids."""

    MAGIC = 0x58454C56

    def __init__(self, buffer: np.ndarray) -> None:
        head = buffer[:16].view("<u4")
        if head[0] != self.MAGIC:
            raise ValueError("not a lexicon")
        arcs, states, entries = map(int, head[1:4])
        at = 16

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            size = np.dtype(kind).itemsize * n
            part = buffer[at : at + size].view(kind)
            at += size + -size % 8
            return part

        self.keys, self.target, self.number, self.final = take("<u4", arcs), take("<u4", arcs), take("<u4", arcs), take("u1", states)
        self.start = take("<u4", entries + 1)
        self.ids = take("<u4", int(self.start[-1]) if entries else 0)
        self._ends = [4 * x for x in self.start.tolist()]

    @staticmethod
    def build(entries: dict[bytes, bytes]) -> bytes:
        """entries: word to little-endian ids. Words come in byte order; each state that can't change any more is replaced by an equal one."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []

        def settle(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path: list[list] = [[False, []]]  # final, arcs (byte, state); the last arc of each is the next on the path
        labels: list[int] = []
        last = b""
        order = sorted(entries)
        for word in order:
            common = 0
            for x, y in zip(last, word):
                if x != y:
                    break
                common += 1
            while len(labels) > common:
                state, byte = settle(path.pop()), labels.pop()
                path[-1][1].append((byte, state))
            for byte in word[common:]:
                labels.append(byte)
                path.append([False, []])
            path[-1][0] = True
            last = word
        while labels:
            state, byte = settle(path.pop()), labels.pop()
            path[-1][1].append((byte, state))
        root = settle(path[0])
        size = [0] * len(states)  # words below; children are settled before their parents
        for i, (final, arcs) in enumerate(states):
            size[i] = final + sum(size[t] for _, t in arcs)
        name = {root: 0} | {s: i + 1 for i, s in enumerate(x for x in range(len(states)) if x != root)}
        rows = []
        for i, (final, arcs) in enumerate(states):
            number = int(final)
            for byte, t in arcs:
                rows.append((name[i] << 8 | byte, name[t], number))
                number += size[t]
        rows.sort()
        table = np.array(rows, np.uint32).reshape(-1, 3)
        final = np.zeros(len(states), np.uint8)
        for i, (f, _) in enumerate(states):
            final[name[i]] = f
        ids = b"".join(entries[w] for w in order)
        start = np.cumsum([0, *(len(entries[w]) // 4 for w in order)]).astype("<u4")
        parts = [np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1]), np.ascontiguousarray(table[:, 2]), final, start, np.frombuffer(ids, "<u4")]
        head = np.array([Lexicon.MAGIC, len(rows), len(states), len(order)], "<u4").tobytes()
        return head + b"".join(p.tobytes() + bytes(-p.nbytes % 8) for p in parts)

    @classmethod
    def mapped(cls, content: bytes) -> Lexicon:
        """Map content from a file in the machine's temporary folder, which has no name there and goes with the worker."""
        with tempfile.TemporaryFile() as f:
            f.write(content)
            f.flush()
            return cls(np.memmap(f, np.uint8, mode="r"))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Ordinal of each word, -1 where it is none."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        if not n or not len(self.keys):
            return np.full(n, -1)
        starts = np.cumsum(lengths) - lengths
        raw = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        state, ordinal, live = np.zeros(n, np.int64), np.zeros(n, np.int64), np.flatnonzero(lengths <= LONGEST)
        out = np.full(n, -1)
        step = 0
        while len(live):
            ended = lengths[live] == step
            at = live[ended]
            out[at] = np.where(self.final[state[at]] == 1, ordinal[at], -1)
            live = live[~ended]
            key = (state[live] << 8 | raw[starts[live] + step]).astype(np.uint32)
            arc = np.searchsorted(self.keys, key)
            arc[arc == len(self.keys)] = 0
            hit = self.keys[arc] == key
            live, arc = live[hit], arc[hit]
            state[live] = self.target[arc]
            ordinal[live] += self.number[arc]
            step += 1
        return out

    def entries(self, ordinals: np.ndarray) -> list[bytes]:
        """The ids of each ordinal, little-endian."""
        view, ends = memoryview(self.ids).cast("B"), self._ends
        return [bytes(view[ends[k] : ends[k + 1]]) for k in ordinals.tolist()]


class Memo:
    """Pieces and their ids: at least the last ``limit`` / 2 that were asked for, at most ``limit`` besides those of one batch."""

    def __init__(self, limit: int) -> None:
        self.half, self.now, self.older = limit // 2, {}, {}

    def get(self, wanted: list[str]) -> list[bytes | None]:
        if len(self.now) > self.half:
            self.now, self.older = {}, self.now
        found = list(map(self.now.get, wanted))
        now, older = self.now, self.older
        for k in [k for k, ids in enumerate(found) if ids is None]:
            if (ids := older.get(wanted[k])) is not None:
                found[k] = now[wanted[k]] = ids
        return found


class PieceEncoder:
    """Encodes texts piece by piece; ``new`` gives the ids of pieces that aren't remembered."""

    def __init__(self, memo: int, special: Iterable[str]) -> None:
        self.memo = Memo(memo)
        self.tails: dict[str, bytes] = {}
        self.specials = sorted(special, key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None

    def new(self, parts: list[str]) -> Iterable[bytes]:
        """Ids of strings that begin where a word begins."""
        raise NotImplementedError

    def special_id(self, token: str) -> int:
        raise NotImplementedError

    def _remember(self, parts: list[str]) -> None:
        for k in range(0, len(parts), 1 << 15):
            some = parts[k : k + (1 << 15)]
            self.memo.now.update(zip(some, self.new([" " + p for p in some])))

    def ids_of(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct pieces, each after a blank. Letters and a tail of signs are two words, so their ids are joined."""
        found = self.memo.get(parts)
        joined, rest = [], []
        for k in [k for k, ids in enumerate(found) if ids is None]:
            piece = parts[k]
            if not piece.isalpha():
                core = piece.rstrip(SIGNS)
                if core.isalpha() and core is not piece and (core.isascii() or max(core) < FURTHER):
                    joined.append((k, core, piece[len(core) :]))
                    continue
            rest.append(k)
        self._remember([parts[k] for k in rest])
        now = self.memo.now
        for k in rest:
            found[k] = now[parts[k]]
        if joined:
            cores = list({core for _, core, _ in joined})
            self._remember([p for p, ids in zip(cores, self.memo.get(cores)) if ids is None])
            now = self.memo.now
            tails = list({tail for _, _, tail in joined} - self.tails.keys())
            if len(self.tails) + len(tails) > 10_000:
                self.tails.clear()
                tails = list({tail for _, _, tail in joined})
            self.tails.update(zip(tails, self.new(tails)))
            ends = self.tails
            for k, core, tail in joined:
                found[k] = now[parts[k]] = now[core] + ends[tail]
        return found

    def _odd(self, text: str) -> bytes:
        """A text with special tokens, or with blanks after other blank characters."""
        out = []
        for k, part in enumerate(self.special_pattern.split(text) if self.special_pattern else [text]):
            if k % 2:
                out.append(self.special_id(part).to_bytes(4, "little"))
            else:
                first, *others = pieces(part)
                place = {p: i for i, p in enumerate(dict.fromkeys(others))}
                ids = self.ids_of(list(place))
                out += [*self.new([first]), *(ids[place[p]] for p in others)]
        return b"".join(out)

    def encode(self, batch: list[str] | pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text; null is the empty text."""
        plain = batch if isinstance(batch, pa.Array) else pa.array(batch, pa.string())
        if plain.null_count:
            plain = pc.fill_null(plain, "")
        odd = pc.match_substring_regex(plain, _BLANK_BEFORE_BLANK_RE2)
        for token in self.specials:
            odd = pc.or_(odd, pc.match_substring(plain, token))
        others = dict.fromkeys(np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist())
        if others:
            others = dict(zip(others, plain.filter(odd).to_pylist()))
            plain = pc.if_else(odd, "", plain)
        cut = pc.split_pattern(plain, " ")
        coded = cut.values.dictionary_encode()
        offsets = cut.offsets.to_numpy()
        index = coded.indices.to_numpy().copy()
        parts = coded.dictionary.to_pylist()
        # the first piece of each text has no blank before it
        firsts: dict[int, int] = {}
        for k in index[offsets[:-1]].tolist():
            firsts.setdefault(k, len(parts) + len(firsts))
        index[offsets[:-1]] = [firsts[k] for k in index[offsets[:-1]].tolist()]
        ids = self.ids_of(parts) + list(self.new([parts[k] for k in firsts]))
        size = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
        start = (np.cumsum(size) - size).astype(np.int32)
        flat = np.frombuffer(b"".join(ids), "<u4")
        n = size[index]
        ends = np.cumsum(n, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total, dtype=np.int32)
        place += np.repeat(start[index] - (ends - n).astype(np.int32), n)
        raw = flat[place].tobytes()
        stops = (4 * np.concatenate(([0], ends))[offsets]).tolist()
        out = [raw[i:j] for i, j in zip(stops, stops[1:])]
        for k, text in others.items():
            out[k] = self._odd(text)
        return out


class Encoder(PieceEncoder):
    """Looks pieces up in the lexicon, and merges those that it lacks."""

    def __init__(self, merges: Merges, lexicon: Lexicon | None, memo: int = MEMO) -> None:
        super().__init__(memo, merges.special)
        self.merges, self.lexicon = merges, lexicon
        self._spans = np.cumsum([0, *map(len, merges.bytes_of)])
        self._flat = np.frombuffer(b"".join(merges.bytes_of), np.uint8)

    def special_id(self, token: str) -> int:
        return self.merges.special[token]

    def new(self, parts: list[str]) -> list[bytes]:
        if self.lexicon is None:
            ids = self.merges.encode_pieces(parts)
            return [ids[p] for p in parts]
        found = self.lexicon.find([p.encode("utf-8", "surrogatepass") for p in parts])
        ids = dict(zip((parts[k] for k in np.flatnonzero(found >= 0).tolist()), self.lexicon.entries(found[found >= 0])))
        ids |= self.merges.encode_pieces([parts[k] for k in np.flatnonzero(found < 0).tolist()])
        return [ids[p] for p in parts]

    def decode_bytes(self, batch: list[bytes]) -> list[bytes]:
        """The bytes that the ids of each text stand for."""
        ids = np.frombuffer(b"".join(batch), "<u4")
        first = self._spans[ids]
        ends = np.cumsum(self._spans[ids + 1] - first)
        total = int(ends[-1]) if len(ids) else 0
        raw = self._flat[np.arange(total) + np.repeat(first - np.concatenate(([0], ends[:-1])), np.diff(ends, prepend=0))] if total else self._flat[:0]
        raw = raw.tobytes()
        stops = np.concatenate(([0], ends))[np.cumsum([0, *(len(x) // 4 for x in batch)])].tolist()
        return [raw[i:j] for i, j in zip(stops, stops[1:])]

    def decode(self, batch: list[bytes]) -> list[str]:
        """Special tokens too; bytes that aren't UTF-8 become U+FFFD."""
        return [x.decode("utf-8", "replace") for x in self.decode_bytes(batch)]


@lru_cache(maxsize=2)
def _merges(source: bytes) -> Merges:
    return Merges(source)


_encoders: dict[tuple[bytes, bytes], Encoder] = {}


def _encoder(source: bytes, content: bytes) -> Encoder:
    """One for each Python worker, which keeps it for later tasks."""
    key = (hashlib.sha256(source).digest(), hashlib.sha256(content).digest())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(_merges(source), Lexicon.mapped(content))
    return _encoders[key]


def settle() -> None:
    """At a task's end: the worker lives on, so what it no longer needs goes back to the machine."""
    gc.enable()
    pa.default_memory_pool().release_unused()


def piece_counts(docs: DataFrame, partial: int = PARTIAL) -> DataFrame:
    """(piece, n) over all documents; a task's partial counts are passed on whenever they hold ``partial`` pieces."""
    schema = pa.schema([("piece", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)
            counts.clear()
            return rows

        for batch in slices(batches, "text"):
            for text in texts(batch):
                counts.update(pieces(text)[1:])
            if len(counts) >= partial:
                yield out()
        yield out()
        settle()

    return docs.select("text").mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def frequent_lexicon(docs: DataFrame, merges: Merges, entries: int = LEXICON) -> bytes:
    """The most frequent pieces of at most LONGEST bytes that come twice or more: as many counts as ``entries`` has room for.

    Pieces of one count (from 1024 on: of one 64th of a power of two) are taken together or not at all, so a histogram
    of bounded size says where to stop, and only what is taken comes to the driver.
    """
    counts = piece_counts(docs).filter((F.col("n") > 1) & (F.octet_length("piece") < LONGEST))
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2(F.col("n")) * 64) + 384)
    counts = materialize(counts.select("piece", level.cast("int").alias("level")), "pieces")
    least, room = 1 << 30, entries
    for row in sorted(counts.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        room -= row["count"]
        if room < 0:
            break
        least = row["level"]
    rows = counts.filter(F.col("level") >= least).select("piece").collect()  # bounded by entries
    ids = merges.encode_pieces([" " + r.piece for r in rows])
    return Lexicon.build({p.encode(): x for p, x in ids.items()})


def encode_documents(docs: DataFrame, *, tokenizer: str | None = None, lexicon: int = LEXICON, with_ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (little-endian 32-bit).

    Ids are those of the tokenizers library for the same file with add_special_tokens=False: the text of a special token
    becomes that token. A null text is the empty text, which has no ids. Very long texts and words are encoded whole.
    Null ids and repeated rows pass through; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    with open(tokenizer or tokenizer_path(), "rb") as f:
        source = f.read()
    rows = docs.select("doc_id", "text")
    content = frequent_lexicon(rows, _merges(source), lexicon)
    shared = spark.sparkContext.broadcast((source, content))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # millions of small objects, none in a cycle
        encoder = _encoder(*shared.value)
        for batch in slices(batches, "text", SLICE):
            ids = encoder.encode(batch.column("text"))
            decoded = [hashlib.sha256(x.encode()).hexdigest() for x in encoder.decode(ids)]
            columns = [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, schema=schema)
        settle()

    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir))

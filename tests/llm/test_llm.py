import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SF
from variorum.llm import bpe, components, exact_dedup, language, language_model, mixing, neighbours, quality, registry, similar, simhash, token_file, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string, tokens array<string>"


def documents(spark, rows):
    """(doc_id, text) or (doc_id, text, lang, source) rows, with columns whose names clash with results."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), 1.5, "x", ["y"]) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


LONG = "lang word " * 60_000
ODD = [(1, None), (2, ""), (3, " \n "), (4, "one"), (4, "one"), (None, "one two"), (5, LONG), (6, "a b c d e"), (7, "A B C D E"), (8, "\U0001f600 漢字 <|endoftext|> x")]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


def corpus(n=40):
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(200)]
    return [(k, " ".join(r.choices(words, k=30))) for k in range(n)]


# --- exact duplicates


def brute_exact(rows):
    key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(key(t), []).append((-len(t or ""), i is None, i or 0))
    return {k: (min(g)[2] if not min(g)[1] else None, len(g)) for k, g in groups.items()}, key


@pytest.mark.parametrize("frequent, counters", [(1024, 8192), (1, 8)])
def test_exact_duplicates(spark, odd, frequent, counters):
    groups, key = brute_exact([r[:2] for r in ODD])
    got = exact_dedup.exact_duplicates(odd, frequent=frequent, counters=counters).collect()
    assert len(got) == len(ODD)
    by_digest = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == by_digest[r.text_sha256]
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(by_digest.keys())


def test_exact_duplicates_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(registry.oracle_sql()["op10_exact_dedup"]).fetchall())
    assert sorted(tuple(r) for r in registry.queries()["op10_exact_dedup"](spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == want


def test_drop_exact_duplicates(odd):
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns
    # null, empty and blank texts are one group, the longest stays; a row that repeats stays once
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [3, 4, 5, 6, 7, 8]


def test_exact_duplicates_of_odd_ids(spark, empty):
    least = -(1 << 63)
    docs = documents(spark, [(least, "a"), (0, "a"), (None, "a"), (5, "b"), (5, "b "), (5, "c"), (None, "d"), (None, "d")]).withColumnRenamed("score", "_key")
    got = {(r.doc_id, r.kept): r.keep_id for r in exact_dedup.exact_duplicates(docs.filter("text = 'a'")).collect()}
    assert got == {(least, True): least, (0, False): least, (None, False): least}
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in kept.collect()) == [(False, least, "a"), (False, 5, "b "), (False, 5, "c"), (True, None, "d")]
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


# --- near duplicates


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, fps):
    label = list(ids)
    while True:
        new = [min(label[j] for j in range(len(ids)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(ids))]
        if new == label:
            return label
        label = new


def test_fingerprints():
    for _, text in [*ODD[:4], *ODD[6:], *corpus(10)]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("per_prefix", [1 << 21, 5000, 300])
def test_ball_links_find_every_pair(spark, per_prefix):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = {0, *base}
    for b in base:
        for _ in range(3):
            fps.add(b ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 6))))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.ball_links(spark.createDataFrame([(x,) for x in signed], "fp long"), len(fps), per_prefix=per_prefix)
    roots = {x.node: x.root for x in components.components(links, "a", "b").collect()}
    assert [roots.get(x, x) for x in signed] == brute_components(signed, fps)


def test_near_duplicates(spark, odd, empty):
    got = {r.doc_id: r for r in simhash.near_duplicates(odd).collect()}
    assert got[1].fingerprint == "0" * 16 and got[1].component_id == got[2].component_id == got[3].component_id == 1
    assert got[7].component_id == 6 and got[4].component_id == 4
    assert simhash.near_duplicates(odd).count() == len(ODD)
    assert simhash.near_duplicates(empty).count() == 0
    assert similar.drop_near_duplicates(odd).columns == odd.columns and similar.drop_near_duplicates(empty).count() == 0


def test_meeting_in_parts():
    """However little is written out at once, the same fingerprints meet."""
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = np.array(sorted({*base, *(b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base)}), np.uint64)
    left = np.full(len(fps), 2)
    assert simhash.meet(fps, left, 0).tolist() == simhash.meet(fps, left, 0, at_once=500).tolist()


def test_components_are_of_texts_and_not_of_ids(spark):
    """Rows that share an id, or have none, are told apart by their texts."""
    a, b = corpus(2)[0][1], corpus(2)[1][1]
    docs = documents(spark, [(3, a), (5, a), (5, b), (None, b), (None, b), (None, a + " zz")])
    got = simhash.near_duplicates(docs)
    fp = {"a": brute_fingerprint(a), "b": brute_fingerprint(b)}
    named = {(r.doc_id, r.fingerprint): r.component_id for r in got.collect()}
    assert named[3, f"{fp['a']:016x}"] == named[5, f"{fp['a']:016x}"] == 3 and named[5, f"{fp['b']:016x}"] == named[None, f"{fp['b']:016x}"] == 5
    kept = [(r.doc_id, r.text) for r in similar.drop_near_duplicates(docs.filter("text not like '%zz'")).collect()]
    assert sorted(kept) == [(3, a), (5, b)]
    # equal texts without ids: one stays
    assert similar.drop_near_duplicates(documents(spark, [(None, a), (None, a)])).count() == 1


def test_near_duplicates_by_similarity(spark):
    """The stage's own rule against all pairs: five words, Jaccard 0.8; op9's four bits find few of them."""
    r = random.Random(8)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(400)]
    boilerplate = " ".join(r.choices(vocabulary, k=30))
    rows = []
    for k in range(30):
        body = r.choices(vocabulary, k=r.randint(40, 200))
        for edits in (0, 1, 2, 3, 5):
            other = list(body)
            for at in r.sample(range(len(other)), edits):
                other[at] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(other) + (" " + boilerplate if k % 2 else "")))
    sets = []
    for _, text in rows:
        w = text.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    fps = [simhash.fingerprint(t, 5) for _, t in rows]
    alike = [[j for j in range(len(rows)) if len(a & sets[j]) / len(a | sets[j]) >= 0.8] for a in sets]
    near = [[j for j in range(len(rows)) if (a ^ fps[j]).bit_count() <= 4] for a in fps]
    label = list(range(len(rows)))
    while (now := [min(label[j] for j in {*alike[i], *near[i]}) for i in range(len(rows))]) != label:
        label = now
    docs = documents(spark, rows)
    kept = {x.doc_id for x in similar.drop_near_duplicates(docs).collect()}
    assert kept == set(label)
    assert len(kept) < simhash.near_duplicates(docs).select("component_id").distinct().count()


def test_components_of_a_path(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {r.node: r.root for r in components.components(links, "a", "b").collect()} == {i: 0 for i in range(1, n + 1)}


# --- BPE and token files


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.tokenizer_path())


def test_merges_equal_the_library(library):
    with open(bpe.tokenizer_path(), "rb") as f:
        merges = bpe.Merges(f.read())
    r = random.Random(6)
    parts = [*"abehnrst ABC  \n\t.,'!0123", "the ", "'s", "ß", "漢字", "́", "<|endoftext|>", "  ", "\n ", " ", "\x1c"]
    texts = ["", " ", "x" * 3000, "a<|endoftext|> b", *("".join(r.choices(parts, k=r.randint(0, 40))) for _ in range(800))]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    lexicon = bpe.Lexicon.mapped(bpe.Lexicon.build({(" " + p).encode(): merges.encode_pieces([" " + p])[" " + p] for p in ("the", "then", "hen", "abe")}))
    for encoder in (bpe.Encoder(merges, None), bpe.Encoder(merges, lexicon), bpe.Encoder(merges, lexicon, memo=10), token_file.LibraryEncoder(open(bpe.tokenizer_path(), "rb").read(), memo=10)):
        assert encoder.encode(texts) == want
    assert bpe.Encoder(merges, None).decode(want) == [library.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in want]


def test_lexicon():
    r = random.Random(7)
    words = {"".join(r.choices("abc", k=r.randint(1, 6))).encode() for _ in range(200)}
    entries = {w: np.array([len(w), k], "<u4").tobytes() for k, w in enumerate(sorted(words))}
    lexicon = bpe.Lexicon.mapped(bpe.Lexicon.build(entries))
    asked = [*words, b"zzz", b"", b"abcabcabcabc"]
    found = lexicon.find(asked)
    for w, k in zip(asked, found):
        assert (k >= 0) == (w in words) and (k < 0 or lexicon.entries(np.array([k]))[0] == entries[w])
    assert len(lexicon.final) < sum(map(len, words))  # suffixes are shared
    assert (bpe.Lexicon.mapped(bpe.Lexicon.build({})).find([b"a"]) == -1).all()


def test_encode_documents(odd, empty, library):
    got = bpe.encode_documents(odd, with_ids=True).collect()
    assert len(got) == len(ODD) and bpe.encode_documents(empty).count() == 0
    for r in got:
        text = next(t for i, t in ODD if i == r.doc_id) or ""
        ids = library.encode(text, add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert r.ids == raw and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("per_file", [32 << 20, 200_000])
def test_token_files(odd, library, per_file):
    got = token_file.read_token_files(token_file.write_token_files(odd, per_file=per_file)).orderBy("start").collect()
    start = 0
    for r, (i, t) in zip(got, sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0))):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_of_an_empty_table(empty):
    assert token_file.read_token_files(token_file.write_token_files(empty)).count() == 0


def test_frames_are_read_alone_and_checked():
    docs = {k: np.arange(k * 10, k * 10 + k, dtype="<u4").tobytes() for k in range(50)}
    sink = io.BytesIO()
    writer = token_file.Writer(sink, frame=256)
    for k, ids in docs.items():
        writer.add(k, ids)
    writer.close()
    raw = sink.getvalue()
    reader = token_file.Reader(pa.PythonFile(io.BytesIO(raw), mode="r"))
    assert dict(reader.read()) == docs and len(reader.table) > 5
    asked, real = [], reader.frame
    reader.frame = lambda k: asked.append(k) or real(k)
    assert dict(reader.read([7])) == {7: docs[7]} and len(asked) == 1
    import zstandard

    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read() for _ in range(1))
    assert whole == b"".join(docs.values())
    broken = bytearray(raw)
    at = int(reader.starts[-1]) + 8 + int.from_bytes(raw[int(reader.starts[-1]) + 4 : int(reader.starts[-1]) + 8], "little") + 8 + 8
    broken[at] ^= 1  # the first frame's checksum
    with pytest.raises(ValueError):
        list(token_file.Reader(pa.PythonFile(io.BytesIO(bytes(broken)), mode="r")).read([1]))


# --- language model


def brute_counts(tokens, docs):
    """Counts of words, of contexts and of pairs; None is the mark before a text's first word."""
    word, context, pair = Counter(), Counter(), Counter()
    for i in docs:
        word.update(tokens[i])
        for v, w in zip([None, *tokens[i]], tokens[i]):
            context[v] += 1
            pair[v, w] += 1
    return word, context, pair


@pytest.mark.parametrize("settings", [{}, {"chunk_words": 200, "per_bucket": 1500}, {"chunk_words": 100, "per_bucket": 300, "fan": 3}])
def test_language_model(spark, monkeypatch, settings):
    rows = [*corpus(40), (100, None), (101, "New UNSEEN words"), *((200 + k, "a \0start") for k in range(5))]
    learned = []
    learn = language_model.learn_weights
    monkeypatch.setattr(language_model, "learn_weights", lambda cells, v: learned.append(learn(cells, v)) or learned[-1])
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in language_model.text_scores(docs, **settings).collect()}
    half = dict(docs.select("doc_id", F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(2))).collect())
    tokens = {i: [*re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()), b""] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    train = [i for i in tokens if not held[i]]
    word, context, pair = brute_counts(tokens, train)
    n, v = sum(word.values()), len(word)
    bucket = lambda c: min(c.bit_length(), language_model.BUCKETS - 1)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(word[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((word[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        want = 0
        for before, w in zip([None, *ws], ws):
            a, b, c = learned[0][bucket(context[before])]
            want += math.log10(a * pair[before, w] / max(1, context[before]) + b * word[w] / n + c / (v + 1))
        assert math.isclose(r.score, want, rel_tol=1e-9)
    # the weights: expectation-maximisation on each half's words, estimated on the other half
    told = {}
    for k in (0, 1):
        others = brute_counts(tokens, [i for i in train if half[i] != k])
        size = sum(others[0].values())
        for i in train:
            if half[i] == k:
                for before, w in zip([None, *tokens[i]], tokens[i]):
                    p = (others[2][before, w] / max(1, others[1][before]), others[0][w] / size, 1 / (v + 1))
                    told.setdefault(bucket(others[1][before]), []).append(p)
    for b, p in told.items():
        p = np.array(p)
        w = np.array([0.0, 0.5, 0.5]) if b == 0 else np.full(3, 1 / 3)
        for _ in range(language_model.ROUNDS):
            share = p * w
            w = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
        # cells hold estimates of one power of two as their mean, so that weights differ a little
        loss = lambda w: -np.log(np.maximum(p @ w, 1e-300)).mean()
        assert loss(learned[0][b]) <= loss(w) + 0.02


def test_language_model_of_odd_tables(odd, empty):
    got = language_model.text_scores(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ODD)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1} and language_model.text_scores(empty).count() == 0
    assert len({r.score for r in got if r.doc_id == 4}) == 1


def test_levels_grow_slowly():
    assert language_model.levels(1) == [1] and language_model.levels(256) == [256] and language_model.levels(257) == [17, 289]
    for buckets in (1000, 70_000, 9_000_000):
        ranges = language_model.levels(buckets)
        assert ranges[-1] >= buckets and all(b == a * ranges[0] for a, b in zip(ranges, ranges[1:])) and ranges[0] <= 256


def test_mixture_weights_are_learned():
    p = [(4096 * 3 + k, 100.0, 100 * a, 100 * b) for k, (a, b) in enumerate([(0.5, 0.001), (0.0, 0.02)])]
    w = language_model.learn_weights(p, 1000)
    assert np.allclose(w.sum(axis=1), 1) and w[3][0] > 0.3 and w[3][1] > 0.2
    assert w[0].tolist() == [0.0, 0.0, 1.0]


# --- classifiers and language


def test_gradients():
    net = quality.Network(seed=1)
    texts = [b"abcd" * 100, b"zz top!!" * 40]
    rows = [quality.chunks(t) for t in texts]
    first, all_rows = np.array([0, len(rows[0])]), np.concatenate(rows)
    label, weight = np.array([1.0, 0.0]), np.ones(2)

    def loss():
        p = np.concatenate([net.combined(net.pooled(all_rows), first)])
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    g = net.gradients(all_rows, first, label, weight)
    for name in ("out", "hidden", "unit", "filter", "left", "bias"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        held = float(net.p[name][at])
        net.p[name][at] = held + 1e-3
        up = loss()
        net.p[name][at] = held - 1e-3
        down = loss()
        net.p[name][at] = held
        assert math.isclose((up - down) / 2e-3, float(g[name][at]), rel_tol=0.08, abs_tol=1e-4), name


def test_chunks_cover_the_document():
    for n in (0, 1, 64, 256, 257, 448, 449, 1000):
        raw = bytes(random.Random(n).choices(range(1, 256), k=n))
        rows = quality.chunks(raw)
        joined = rows[0].tobytes() + b"".join(r[quality.CHUNK - quality.STEP :].tobytes() for r in rows[1:])
        assert joined.rstrip(b"\0") == raw and rows.shape[1] == quality.CHUNK


@pytest.mark.parametrize("scores, label", [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_classifiers(spark, odd, empty, scores, label):
    r = random.Random(8)
    good = lambda: " ".join("".join(r.choices("aeiourtn", k=5)) for _ in range(80))
    bad = lambda: good() + (" BUY!!! $$$ NOW" * 20 if label == "quality" else " you horrid vermin" * 3)
    one, zero = (good, bad) if label == "quality" else (bad, good)
    rows = [(k, one() if k % 2 else zero()) for k in range(240)]
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k, _ in rows], "doc_id long, quality int, toxic int")
    got = scores(documents(spark, rows), labels).collect()
    held = [x for x in got if x.held_out]
    assert len(got) == 240 and sum(x.predicted == x.doc_id % 2 for x in held) > 0.95 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got)
    assert scores(odd, labels).count() == len(ODD) and scores(empty, labels.limit(0)).count() == 0
    assert {round(x.score, 6) for x in scores(documents(spark, [(5, None), (6, "x")]), labels.limit(0)).collect()} == {0.5}


def test_labelled_sample_is_bounded(spark):
    long = " ".join(f"w{k}" for k in range(20_000))
    rows = [*((7, f"text {k}") for k in range(500)), (8, "both"), (9, long), (10, None)]
    labels = spark.createDataFrame([(7, 1), (8, 0), (8, 1), (9, 0), (9, 0), (10, 0), (None, 1), (11, None)], "doc_id long, quality int")
    got = quality.labelled_sample(documents(spark, rows), labels, "quality", 1 << 20, 3)
    assert [y for _, y in got] == [1, 0, 0] and got[2] == ("", 0)
    assert len(got[1][0]) == quality.LONGEST_SAMPLE and got[1][0].startswith("w0 w1") and got[1][0].endswith("w19999")


def test_toxic_windows_and_their_lengths():
    """The toxic dictionary is trained on windows of toxic texts; differences are those of plain compression."""
    import zstandard

    r = random.Random(3)
    plain = [" ".join("".join(r.choices("aeiourtn", k=5)) for _ in range(60)) for _ in range(150)]
    toxic = [t + " horrid vermin" for t in plain[100:]]
    assert set(toxicity.toxic_windows(toxic, plain[:100])) == {b" horrid ", b" vermin "}
    model = toxicity.Toxicity(toxicity.trained([b" horrid ", b" vermin "] * 50, 64), toxicity.trained(toxicity.ordinary_windows(plain[:100]), 4000))
    params = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, window_log=18, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    for word in (b"vermin", b"horrid", b"aeiou", b"x" * 150):
        size = []
        for content in (model.ordinary, model.toxic + model.carrier):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            size.append([len(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress((b" " + word + b" ")[k : k + 64] + model.carrier)) for k in range(0, max(1, len(word) + 2 - 32), 32)])
        assert model.difference(word) == max(a - b for a, b in zip(*size))
    assert model.difference(b"vermin") > model.difference(b"aeiou")


def test_networks_score_by_hand():
    net = quality.Network(seed=2)
    text = b"Some text of more than one chunk. " * 20
    p, hidden = net.p, []
    for row in quality.chunks(text):
        x = p["byte"][row]
        z = []
        for at in range(0, quality.CHUNK - 2 * quality.STRIDE + 1, quality.STRIDE):
            left, right = x[at : at + quality.STRIDE].ravel(), x[at + quality.STRIDE : at + 2 * quality.STRIDE].ravel()
            z.append(np.maximum(left @ p["left"] + right @ p["right"] + p["filter"], 0))
        hidden.append(np.maximum(np.concatenate([np.max(z, axis=0), np.mean(z, axis=0)]) @ p["hidden"] + p["unit"], 0))
    d = np.concatenate([np.max(hidden, axis=0), np.mean(hidden, axis=0)])
    assert math.isclose(net.score([text, b""])[0], 1 / (1 + math.exp(-(d @ p["out"] + p["bias"][0]))), rel_tol=1e-4)


def test_languages(spark, odd, empty):
    got = {r.doc_id: r for r in language.languages(odd).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[4].lang_pred == "en"
    assert language.languages(empty).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    x = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert x > 0.9


def test_out_of_place_distance_by_hand():
    known = {"aa": "abra kadabra", "bb": "simsalabim sesam"}
    ranked = {k: language.ranking(*language.ngram_counts(t), 12).tolist() for k, t in known.items()}
    identifier = language.Identifier({k: np.array(v, np.int64) for k, v in ranked.items()}, 12)
    for text in ("abra", "sesam", "bim bam", "x"):
        own = language.ranking(*language.ngram_counts(text), 12).tolist()
        distance = {k: sum(abs(v.index(g) - i) if g in v else 12 for i, g in enumerate(own)) for k, v in ranked.items()}
        best = min(sorted(distance), key=distance.get)
        assert identifier.identify(text) == (best, 1 - distance[best] / (12 * len(own)))


def test_profiles_against_counting():
    text = "Abba, abä! ab12"
    keys, n = language.ngram_counts(text)
    words = ["_abba_", "_abä_", "_ab_"]
    want = Counter()
    for w in words:
        for k in (1, 2, 3):
            want.update(w[i : i + k] for i in range(len(w) - k + 1) if w[i : i + k] != "_")
    name = lambda key: "".join("_" if (c := key >> s & 0x1FFFFF) == 1 else chr(c - 1) for s in (42, 21, 0) if key >> s)
    assert {name(int(k)): int(c) for k, c in zip(keys, n)} == dict(want)


# --- mixing, neighbours, pipeline


def test_mixing(spark, odd, empty):
    r = random.Random(9)
    rows = [(k, "w " * r.randint(1, 40), "en", "big" if k % 3 else f"s{k % 7}") for k in range(600)]
    docs = documents(spark, rows)
    got = mixing.mixture(docs, entropy=None, repeats=2.0).collect()
    size = Counter()
    for k, t, _, s in rows:
        size[s] += len(t.split())
    total = sum(size.values())
    weights = {x.source: x.weight for x in got}
    assert math.isclose(sum(weights.values()), 1, rel_tol=1e-9)
    given = Counter()
    for x in got:
        given[x.source] += x.n_tokens
    for s, n in size.items():
        assert weights[s] * total <= 2.0 * n + 1e-6
        assert given[s] <= weights[s] * total + 1e-6 and weights[s] * total - given[s] < 41
    times = Counter((x.doc_id, x.epoch) for x in got)
    assert set(times.values()) == {1}  # a document comes once in an epoch
    h = lambda a: (lambda p: -sum(x * math.log(x) for x in p))([n**a / sum(m**a for m in size.values()) for n in size.values()])
    alpha = mixing.exponent(spark.createDataFrame([(s, float(n)) for s, n in size.items()], "source string, tokens double"), entropy=0.95, repeats=None)
    assert abs(h(alpha) - 0.95 * math.log(len(size))) < 1e-4
    assert mixing.mixture(empty).count() == 0
    assert mixing.mix_sources(odd).columns == odd.columns and mixing.mixture(odd).filter("doc_id = 5").count() <= 1


def test_mixing_limits(spark, empty):
    table = lambda *sizes: spark.createDataFrame([(str(k), float(n)) for k, n in enumerate(sizes)], "source string, tokens double")
    h = lambda sizes, a: (lambda p: -sum(x * math.log(x) for x in p))([(n / max(sizes)) ** a / sum((m / max(sizes)) ** a for m in sizes) for n in sizes])
    near = (100, 101, 99, 100, 100.5)
    assert math.isclose(h(near, mixing.exponent(table(*near), entropy=0.97, repeats=None)), 0.97 * math.log(5), rel_tol=1e-4)
    assert mixing.exponent(table(7, 7, 7), entropy=0.9, repeats=None) == 1.0
    rows = [(k, "w " * (1 + k % 7), "en", f"s{k % 3}") for k in range(300)]
    docs = documents(spark, rows)
    # no exponent keeps five times all tokens within two repeats: each source is given twice
    total = sum(len(t.split()) for _, t, *_ in rows)
    given = mixing.mixture(docs, entropy=None, repeats=2.0, budget=5.0 * total).groupBy("doc_id").count().collect()
    assert len(given) == 300 and {r["count"] for r in given} == {2}


def test_mixing_of_shared_ids(spark, empty):
    rows = [(1, "a " * 10, "en", "x"), (1, "b " * 10, "en", "y"), (1, "c", "en", "y"), *((None, "d e", "en", "x") for _ in range(50)), *((k, "f g h", "en", "y") for k in range(2, 60))]
    docs = documents(spark, rows).withColumnRenamed("score", "_time").withColumnRenamed("fingerprint", "_KEY")
    for repeats in (1.0, 3.0):
        plan = Counter((r.doc_id, r.source, r.n_tokens) for r in mixing.mixture(docs, entropy=None, repeats=repeats, budget=300.0).collect())
        out = mixing.mix_sources(docs, entropy=None, repeats=repeats, budget=300.0)
        assert out.columns == docs.columns
        assert Counter((r.doc_id, r.source, len(r.text.split())) for r in out.collect()) == plan
        assert plan[None, "x", 2] % 50 == 0
    assert mixing.mix_sources(empty).count() == 0


def test_mixture_order(spark):
    """Blocks in the order of the seeded hash, and the cut within the last one, recomputed."""
    rows = [(k, "w " * (1 + k % 5), "en", "big" if k % 4 else "small") for k in range(400)]
    got = mixing.mixture(documents(spark, rows), entropy=None, repeats=1.0).collect()
    hashed = spark.createDataFrame([(e, s, b) for s in ("big", "small") for e in (0, 1) for b in range(mixing.BLOCKS)], "epoch int, s string, block int")
    place = {(r.s, r.epoch, r.block): r.h for r in hashed.withColumn("h", F.xxhash64(F.lit(mixing.SEED), "epoch", "s", "block")).collect()}
    for s in ("big", "small"):
        mine = [r for r in got if r.source == s and r.epoch == 0]
        in_order = sorted({r.block for r in mine}, key=lambda b: (place[s, 0, b], b))
        assert [r for r in sorted({(r.block_place, r.block) for r in mine})] == [(k + 1, b) for k, b in enumerate(in_order)]


def test_neighbours(spark):
    r = np.random.default_rng(10)
    x = r.normal(size=(300, 8)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 8), (1040, [math.nan] * 8), (1060, [1.0, None] * 4), (1080, [1.0]), (None, [1.0] * 8)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)), kept=60).collect()
    hits = 0
    for q in range(0, 300, 20):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        want = np.lexsort((np.arange(300), -s))[:20].tolist()
        mine = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 21)) and all(abs(m[2] - s[m[1]]) < 1e-9 for m in mine)
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(mine, mine[1:]))
        hits += len({m[1] for m in mine} & set(want))
    assert {g.query_id for g in got} == set(range(0, 300, 20)) and hits >= 0.9 * 300
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_of_doubles_and_repeated_ids(spark):
    rows = [(0, [1.0, 1e-9]), (20, [1.0, 2e-9]), (1, [61.0, 61.0]), (1, [61.0, 61.0]), (2, [3.0, 1.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    mine = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == 0)
    assert mine == [(1, 1, 61.0 + 61.0 * 1e-9), (2, 1, 61.0 + 61.0 * 1e-9), (3, 2, 3.0 + 1e-9), (4, 20, 1.0 + 1e-9 * 2e-9)]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "encoding"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        if name in ("exact_dedup", "near_dedup"):
            fps = [brute_fingerprint(r.text) for r in docs.collect()]
            if name == "near_dedup":
                assert all((a ^ b).bit_count() > 4 for i, a in enumerate(fps) for b in fps[:i])
            texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in docs.collect()]
            assert len(set(texts)) == len(texts)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()

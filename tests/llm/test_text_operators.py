"""Toxicity, quality, fingerprints, packing and BPE on edge cases and against brute force."""

import base64
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from factorloom.llm import bpe, fingerprints, hashing, packing, pretokens, quality, queries, toxicity  # noqa: E402
from tests.conftest import SMALL  # noqa: E402

LONG = "word " * 5000 + "ünï " * 3000 + "x" * 300
EDGE = [(1, "Hello there, general. It's fine!", "a"), (2, None, "b"), (3, "", None), (4, LONG, "c"),
        (5, "Same text here", "d"), (6, "Same text here", "e"), (5, "Same text here", "d"),
        (None, "no id 日本語 !!", "f"), (8, " \n\t ", "g"), (9, "1 2 3 four", "h")]
# Names that the operators use inside or return.
COLUMNS = "doc_id long, text string, body string, f string, c0 string, score double, ids string, sketch string"


def edge(spark):
    return spark.createDataFrame([(k, t, x, x, x, 1.5, x, x) for k, t, x in EDGE], COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


# --- hashing and pieces ----------------------------------------------------------

def test_words_and_shingles_equal_a_plain_split():
    texts = [t for _, t, _ in EDGE] + ["a-b_c", "Ä ö", "x" * 5000 + " y"]
    hashes, first, _, _ = hashing.words(pa.array(texts))
    plain = [re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower()) for t in texts]
    assert np.diff(first).tolist() == [len(p) for p in plain]
    by_word = {}
    for word, h in zip([w for p in plain for w in p], hashes.tolist()):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)
    _, start = hashing.shingles(hashes, first)
    assert np.diff(start).tolist() == [max(len(p) - 4, min(len(p), 1)) for p in plain]


def test_words_do_not_depend_on_the_window(monkeypatch):
    texts = pa.array([t for _, t, _ in EDGE])
    whole = hashing.words(texts)[0]
    monkeypatch.setattr(hashing, "WINDOW", 7)
    np.testing.assert_array_equal(hashing.words(texts)[0], whole)


def test_pieces_equal_the_pattern():
    import regex
    rng = np.random.default_rng(0)
    parts = ["a", "'s", "'", "'re", " ", "  ", "\n", "1", "²", "é", "日", "!", " ", "\x1c", "ll", "𝒜", "'t"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 20))) for _ in range(3000)] + [LONG]
    data, start, length, first = pretokens.pieces(pa.array(texts))
    found = [data[p:p + n].tobytes().decode() for p, n in zip(start, length)]
    for k, text in enumerate(texts):
        assert found[first[k]:first[k + 1]] == regex.findall(public_tokenizers.PATTERN, text)


# --- toxicity --------------------------------------------------------------------

def planted(spark, n=400):
    rng = np.random.default_rng(5)
    rows, marks = [], []
    for k in range(n):
        words = rng.choice([f"w{i}" for i in range(200)], 60).tolist()
        bad = int(k % 5 == 0)
        if bad:
            words[30] = rng.choice(["grumblus", "grumbling", "snarkite"])
        rows.append((k, " ".join(words[:20]) + ". " + " ".join(words[20:40]) + ". " + " ".join(words[40:])))
        marks.append((k, bad))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_toxicity_is_learned_from_text_labels_and_found_in_the_sentence(spark):
    documents, marks = planted(spark)
    model = toxicity.fit(documents, marks, learn=F.col("doc_id") % 4 != 2)
    found = toxicity.score(documents, model).join(marks, "doc_id").where("doc_id % 4 = 2").toPandas()
    predicted = found.score >= toxicity.THRESHOLD
    assert (predicted == (found.toxic == 1)).mean() > 0.97
    texts = {r.doc_id: r.text for r in documents.collect()}
    for row in found[predicted & (found.toxic == 1)].itertuples():
        assert any(re.search("grumbl|snark", texts[row.doc_id][s.start:s.end]) for s in row.offending)
        assert len(row.offending) == 1


def test_toxicity_of_edge_cases(spark):
    documents, marks = planted(spark, 100)
    model = toxicity.fit(documents, marks)
    found = toxicity.score(edge(spark), model)
    assert found.columns == ["doc_id", "body", "f", "c0", "score", "ids", "sketch", "score_", "offending"]
    rows = found.collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score_ <= 1 for r in rows)
    assert {r.score_ for r in rows if r.doc_id in (2, 3, 8)} == {0.0}
    assert len({r.score_ for r in rows if r.doc_id in (5, 6)}) == 1
    assert toxicity.score(empty(spark), model).count() == 0
    nothing = toxicity.fit(empty(spark), spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int"))
    assert max(r.score_ for r in toxicity.score(edge(spark), nothing).collect()) < toxicity.THRESHOLD


def test_toxicity_scores_equal_a_loop_over_sentences_and_words(spark, documents):
    """Noisy-or and offending sentences of the whole table, word by word, for given weights."""
    word = r"[0-9a-zA-Z\u0080-\U0010ffff]+"
    texts = {r.doc_id: (r.text or "").lower() for r in documents.collect()}
    vocabulary = sorted({w for t in texts.values() for w in re.findall(word, t)})
    buckets = dict(zip(vocabulary, toxicity.features(pa.array(vocabulary))[0].T.tolist(), strict=True))
    assert all(buckets[w][1] == buckets[w[:4]][1] for w in vocabulary if w.isascii() and w[:4] in buckets)
    places = np.array(sorted({b for row in buckets.values() for b in row}), np.int32)
    weights = np.random.default_rng(8).normal(0, .3, len(places))
    weight, bias = dict(zip(places.tolist(), weights.tolist())), -3.0
    worth = {w: sum(weight[b] for b in row) for w, row in buckets.items()}
    rows = toxicity.score(documents, (places, weights, bias)).collect()
    assert len(rows) == len(texts)
    scores, offending = [], 0
    for row in rows:
        sentences, open_ = [], False
        for m in re.finditer(rf"[.!?\n]|{word}", texts[row.doc_id]):
            if m[0] in ".!?\n":
                open_ = False
                continue
            if not open_:
                sentences.append([m.start(), bias])
                open_ = True
            sentences[-1][1] += worth[m[0]]
        chances = [1 / (1 + math.exp(-max(min(z, 30), -30))) for _, z in sentences]
        clean = 1.0
        for p in chances:
            clean *= 1 - p
        scores.append(1 - clean)
        assert abs(row.score - (1 - clean)) < 1e-5
        sure = {at for (at, _), p in zip(sentences, chances) if p >= toxicity.THRESHOLD + 1e-5}
        maybe = {at for (at, _), p in zip(sentences, chances) if p >= toxicity.THRESHOLD - 1e-5}
        assert sure <= {x.start for x in row.offending} <= maybe
        offending += len(sure)
    assert offending > 100 and min(scores) < .2 and max(scores) > .8


def test_toxicity_query_learns_on_its_rows_only(spark, labels):
    rows = queries.op1_toxicity(spark, SMALL).join(labels, "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(k).encode()) % 4 == 2 for k in rows.doc_id]).all()
    assert set(rows.predicted[rows.score >= 0.3]) <= {1} and set(rows.predicted[rows.score < 0.3]) == {0}
    assert rows.predicted[rows.toxic == 0].mean() < 0.05


# --- quality ---------------------------------------------------------------------

def test_quality_keeps_good_and_drops_bad_unseen_texts(spark):
    found = queries.op3_importance_resampling(spark, SMALL)
    marks = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = found.join(marks, "doc_id").where(queries.held_out()).toPandas()
    assert (rows.kept == (rows.quality == 1)).mean() > 0.95


def test_sampling_takes_the_k_largest(spark, documents, labels):
    for k in (1, 137, 999):
        rows = quality.resample(documents.select("doc_id", "text"), labels, k=k).toPandas()
        assert rows.kept.sum() == k
        assert rows[rows.kept].sample_key.min() >= rows[~rows.kept].sample_key.max()
    kept = {r.doc_id for r in quality.sampled(documents, labels, k=137).collect()}
    again = quality.resample(documents.select("doc_id", "text"), labels, k=137).where("kept").collect()
    assert kept == {r.doc_id for r in again}


def test_kth_largest_equals_a_sort(spark, monkeypatch):
    monkeypatch.setattr(quality, "FEW", 5)
    monkeypatch.setattr(quality, "BINS", 4)
    values = np.random.default_rng(1).normal(size=500).round(2).tolist() + [7.0] * 50
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for k in (1, 50, 51, 300, 550):
        assert quality.kth_largest(df, "v", k) == sorted(values)[-k]
    assert quality.kth_largest(df, "v", 551) is None and quality.kth_largest(df, "v", 0) is None


def test_gumbel_noise_samples_in_proportion():
    """The first of the Gumbel order falls on each item as often as its weight says."""
    weights = np.array([0.5, 0.3, 0.2])
    noise = -np.log(-np.log(np.random.default_rng(0).random((20000, 3))))
    first = np.argmax(np.log(weights) + noise, axis=1)
    np.testing.assert_allclose(np.bincount(first) / 20000, weights, atol=0.02)


def test_texts_are_sampled_in_proportion_to_their_weights(spark, monkeypatch):
    """Inclusion frequencies of three kinds of texts against drawing one after the other by weight."""
    kinds, weights, n, k = ("low lo", "mid mi", "high hi"), (-1.5, 0.0, 1.0), 3000, 4000
    ratios = np.zeros(quality.PLACES)
    for text, weight in zip(kinds, weights):  # all n-grams of a text have its ratio
        ratios[quality.grams(pa.array([text]))[0]] = weight / quality.LENGTH
    df = spark.createDataFrame([(i * 3 + j, t) for i in range(n) for j, t in enumerate(kinds)], "doc_id long, text string")
    scored = quality.score(df, ratios).join(df, "doc_id").cache()
    assert scored.where(F.abs(F.col("log_ratio") * quality.LENGTH - F.when(F.col("text") == "low lo", -1.5).when(
        F.col("text") == "mid mi", 0.0).otherwise(1.0)) > 1e-9).isEmpty()
    limit = quality.threshold(scored, k)
    found = {r.text: r["count"] / n for r in scored.where(F.col("sample_key") >= limit).groupBy("text").count().collect()}
    # Drawing without replacement: time to the draw is exponential, so a kind is in with 1 - exp(-w t).
    rate, low, high = np.exp(weights), 0.0, 50.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if (1 - np.exp(-rate * middle)).sum() * n < k else (low, middle)
    for text, p in zip(kinds, 1 - np.exp(-rate * low)):
        assert abs(found[text] - p) < 4 * (p * (1 - p) / n) ** .5, text
    expected = sum(n / (1 + np.exp(-(w + quality.LOG_ODDS))) for w in weights)
    assert quality.expected(scored) == round(expected)


def test_quality_of_edge_cases(spark, labels):
    rows = quality.resample(edge(spark), labels).collect()
    assert len(rows) == len(EDGE)
    assert not any(r.kept for r in rows if r.doc_id in (2, 3, 8))
    assert quality.resample(empty(spark), labels).count() == 0
    assert quality.sampled(edge(spark), labels).columns == edge(spark).columns


# --- fingerprints ----------------------------------------------------------------

def shingle_set(text):
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


def test_edited_neighbours_equal_a_loop(spark, documents):
    rows = sorted(((r.doc_id, r.text) for r in documents.collect()), reverse=True)
    found = {r.doc_id: r for r in fingerprints.edited_neighbours(documents).collect()}
    assert len(found) == len(rows)
    errors = []
    for k, (key, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        assert found[key].n_chars == len(text)
        assert found[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, got in ((edited, found[key].near_edited), (following, found[key].near_next)):
            a, b = shingle_set(text), shingle_set(other)
            errors.append(got - (len(a & b) / len(a | b) if a | b else 1.0))
    assert abs(np.mean(errors)) < 0.01 and np.quantile(np.abs(errors), 0.99) < 0.15


def test_sketches_merge_into_that_of_the_whole(spark, documents):
    parts = fingerprints.sketches(documents.select("text", (F.col("doc_id") % 3).alias("part")))
    merged = {r.part: r.sketch for r in fingerprints.merge(parts, "part").collect()}
    for part, sketch in merged.items():
        own = [r.text for r in documents.where(F.col("doc_id") % 3 == part).collect()]
        assert sketch == np.unique(hashing.text_shingles(pa.array(own))[0].view(np.int64))[:fingerprints.K].tolist()
    counted = fingerprints.merge(parts, "part").select(
        "part", fingerprints.distinct(F.col("sketch")).alias("n")).collect()
    for part, n in counted:
        whole = len(set().union(*[shingle_set(r.text) for r in documents.where(F.col("doc_id") % 3 == part).collect()]))
        assert n == pytest.approx(whole, rel=0.35)


def test_resemblance_and_containment(spark):
    base = " ".join(f"a{i}" for i in range(60))
    df = spark.createDataFrame([(0, base, base), (1, base, base + " " + " ".join(f"b{i}" for i in range(30))),
                                (2, None, ""), (3, "", "one two"), (4, "one two", "")], "k int, x string, y string")
    sketched = fingerprints.sketches(fingerprints.sketches(df, "x", sketch="p"), "y", sketch="q")
    rows = sketched.orderBy("k").select(fingerprints.resemblance(F.col("p"), F.col("q")).alias("r"),
                                        fingerprints.containment(F.col("p"), F.col("q")).alias("c"),
                                        fingerprints.distinct(F.col("p")).alias("n")).collect()
    assert [tuple(r) for r in rows] == [(1, 1, 56), (56 / 86, 1, 56), (1, 1, 0), (0, 1, 0), (0, 0, 1)]


def test_fingerprints_of_edge_cases(spark):
    rows = fingerprints.edited_neighbours(edge(spark)).collect()
    assert len(rows) == len(EDGE)
    assert len({r.fingerprint for r in rows if r.doc_id in (5, 6)}) == 1
    assert {r.fingerprint for r in rows if r.doc_id in (2, 3, 8)} == {""}
    assert fingerprints.edited_neighbours(empty(spark)).count() == 0
    one = fingerprints.edited_neighbours(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    assert fingerprints.sketches(edge(spark)).columns[-1] == "sketch_"


# --- packing ---------------------------------------------------------------------

def check_packing(rows, texts):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    documents = {}
    for row in rows:
        documents.setdefault(row.doc_id, []).append(row)
    for key, text in texts.items():
        expected = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(documents[key], key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == expected
        assert {r.doc_tokens for r in own} == {len(expected)}
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
    sequences = {}
    for row in rows:
        sequences.setdefault(row.sequence_id, []).append(row)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in pieces])
        assert [r.offset for r in pieces] == [0, *ends[:-1]] and ends[-1] <= packing.CAPACITY
        assert ends[-1] & (ends[-1] - 1) == 0  # full, or a power of two
    return sequences


def test_packing_covers_each_id_once_without_padding(spark, documents):
    rows = packing.pack(documents, public_tokenizers.path("byte_bpe_50k.json")).collect()
    check_packing(rows, {r.doc_id: r.text for r in documents.collect()})


def test_batches_leave_no_more_small_sequences(spark, documents, monkeypatch):
    few = documents.limit(60).coalesce(1)
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    run = packing._packed
    ready = few.select(F.col("doc_id").alias("key_"), F.col("text").alias("body"))

    def small(batches):
        packing.BATCH = 3000
        yield from run(vocabulary, 0)(batches)

    rows = ready.mapInArrow(small, packing._LAYOUT).withColumnRenamed("key_", "doc_id").collect()
    sequences = check_packing(rows, {r.doc_id: r.text for r in few.collect()})
    assert sum(sum(r.length for r in p) < packing.CAPACITY for p in sequences.values()) <= 10


def test_pieces_go_to_the_lowest_cost_with_room():
    lengths = np.array([600, 500, 400, 300, 200, 48])
    placed = packing.assign(lengths, np.array([1024, 1024]))
    assert [(p, at) for p, start, n, at in placed][:4] == [(0, 0), (1, 1), (2, 1), (3, 0)]
    assert sorted(sum(n for p, _, n, _ in placed if p == k) for k in range(6)) == sorted(lengths)
    costs = [sum(packing.cost(n) for *_, n, at in placed if at == k) for k in (0, 1)]
    assert max(costs) / min(costs) < 1.15


def test_packing_of_edge_cases(spark):
    unique = [r for r in edge(spark).where("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    df = edge(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    check_packing(rows, {r.doc_id: r.text for r in unique})
    whole = packing.pack(edge(spark), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sum(r.length for r in whole if r.start == 0 and r.doc_tokens == r.length) > 0
    assert packing.pack(empty(spark), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


# --- byte-level BPE --------------------------------------------------------------

@pytest.fixture(scope="module")
def encoding():
    import tiktoken
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path),
                                   special_tokens={})


def test_bpe_equals_tiktoken_and_comes_back(spark, documents, encoding):
    path, reference = encoding
    rows = queries.op8_recursive_bpe(spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert len(rows) == len(texts)
    for row in rows:
        ids = reference.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_bpe_of_edge_cases(spark, encoding):
    path, reference = encoding
    encoded = bpe.encode(edge(spark), path)
    assert encoded.columns[-1] == "ids_"
    rows = bpe.decode(encoded, path, "ids_").collect()
    assert len(rows) == len(EDGE)
    texts = {}
    for key, text, _ in EDGE:
        texts[key] = text or ""
    for row in rows:
        assert row.ids_ == reference.encode_ordinary(texts[row.doc_id])
        assert bytes(row.decoded) == texts[row.doc_id].encode()
    assert bpe.encode(empty(spark), path).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), path).first().decoded == b""


def test_bpe_of_long_pieces_takes_several_queries(encoding):
    path, reference = encoding
    pieces = [b"a" * 300, b"abcabc" * 60, "éà".encode() * 80, b"the"]
    found = [np.frombuffer(x, "<i4").tolist() for x in bpe.encode_pieces(path, pieces)]
    assert found == [reference.encode_ordinary(p.decode()) for p in pieces]


def test_unknown_ids_fail(encoding):
    with pytest.raises(ValueError):
        bpe.decode_lists(encoding[0], [np.array([999_999])])


def test_base64_of_a_sketch_is_the_hashes():
    sketch = np.array([-5, 3, 9], np.int64)
    raw = base64.b64decode(fingerprints.text_form(sketch))
    assert np.frombuffer(raw, ">i8").tolist() == [-5, 3, 9] and math.isclose(fingerprints.likeness(sketch, sketch), 1)


# --- texts that simple hashes confuse --------------------------------------------

def thue_morse(size, one, two):
    return "".join(two if bin(k).count("1") % 2 else one for k in range(size))


def confusing():
    """Pairs of different single words: Thue-Morse words, and two letters exchanged 4,096 places apart."""
    pairs = [(thue_morse(n, "a", "b"), thue_morse(n, "b", "a")) for n in (1024, 2048, 4096)]
    word = [chr(97 + k % 23) for k in range(9000)]
    other = list(word)
    other[100], other[4196] = word[4196], word[100]
    assert other != word
    return pairs + [("".join(word), "".join(other))]


def test_confusing_words_are_told_apart(spark):
    from factorloom.llm import near_dedup
    texts = [t for pair in confusing() for t in pair]
    hashes, _, _, _ = hashing.words(pa.array(texts))
    assert len(set(hashes.tolist())) == len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert {r.id: r.class_id for r in near_dedup.classes(df).collect()} == {k: k for k in range(len(texts))}
    sketched = [tuple(r.sketch) for r in fingerprints.sketches(df).collect()]
    assert len(set(sketched)) == len(texts)
    rows = fingerprints.edited_neighbours(df).collect()
    assert all(r.near_next == 0 for r in rows)


@pytest.mark.parametrize("turned", [False, True])
def test_confusing_pieces_get_their_own_ids(spark, turned):
    import tiktoken
    texts = [t for pair in confusing() for t in (pair[::-1] if turned else pair)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    check_packing(packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).collect(), dict(enumerate(texts)))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    short = df.where("length(text) <= 2048")  # a step of the query contracts one pair of a piece
    for row in bpe.decode(bpe.encode(short.select("doc_id", "text"), path), path).collect():
        assert row.ids == encoding.encode_ordinary(texts[row.doc_id])
        assert bytes(row.decoded).decode() == texts[row.doc_id]


def test_the_memory_of_a_bpe_worker_is_bounded():
    """Peak of a process of its own over 6 MB of distinct words."""
    import subprocess
    import sys
    code = """
import re, sys
import numpy as np, pyarrow as pa
from factorloom.llm import bpe
random = np.random.default_rng(5)
words = ["".join(chr(97 + k) for k in random.integers(0, 26, 9)) for _ in range(600_000)]
texts = [" ".join(words[k:k + 500]) for k in range(0, len(words), 500)]
batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["f"])
n = sum(len(out.column(0)) for out in bpe._encoded(sys.argv[1])([batch]))
assert n == len(texts)
print(int(re.search("VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10)  # of this program alone
"""
    done = subprocess.run([sys.executable, "-c", code, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")],
                          capture_output=True, text=True, check=True, timeout=600)
    assert int(done.stdout) < 500

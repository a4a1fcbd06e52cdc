"""Token alignment, suffix-array decontamination and Merkle manifests against plain loops."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from factorloom.llm import alignment, merkle, suffixes  # noqa: E402
from tests.conftest import TINY  # noqa: E402

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, body string, node string, items string"


def frame(spark, rows):
    """(doc_id, text, source) rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(k, t, "x" if t else None, s, len(t) if t is not None else None, "b", "n", "i")
                                  for k, t, s in rows], DOCUMENTS)


# --- alignment -------------------------------------------------------------------

def plain_alignment(texts):
    """(n_a, n_b, n_groups, links, hash) of each text, by bytes and sets."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    symbol = alignment.byte_of_symbol()
    names = {k: t for t, k in one.get_vocab().items()}
    two = SentencePieceProcessor(model_file=B)

    def piece(k):
        return bytes([int(two.id_to_piece(k)[1:-1], 16)]) if two.is_byte(k) else \
            two.id_to_piece(k).replace("▁", " ").encode()

    for text in texts:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        a_bytes, b_bytes = [bytes(symbol[c] for c in names[k]) for k in a], [piece(k) for k in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            yield 0, 0, 0, [], ""
            continue
        a_ends, b_ends = (np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes))
        at_a = dict(zip(a_ends, a))
        found = [(at_a[e], k) for e, k in zip(b_ends, b) if e in at_a]
        groups, low_a, low_b = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            high_a, high_b = a_ends.index(end) + 1, b_ends.index(end) + 1
            groups.append(",".join(map(str, a[low_a:high_a])) + "|" + ",".join(map(str, b[low_b:high_b])))
            low_a, low_b = high_a, high_b
        yield len(a), len(b), len(groups), found, hashlib.sha256(";".join(groups).encode()).hexdigest()


def check_alignment(df, rows):
    made = list(plain_alignment([t for _, t, *_ in rows]))
    counts = Counter(pair for m in made for pair in m[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    expected = Counter((k, m[0], m[1], m[2], len(m[3]), sum(counts[p] == most[p[1]] for p in m[3]),
                        sum(counts[p] for p in m[3]), m[4]) for (k, *_), m in zip(rows, made))
    found = alignment.statistics(df, A, B).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(map(tuple, found.collect())) == expected


TEXTS = [(1, "Hello there, general.\n\nIt's  fine!", "a"), (2, None, "a"), (3, "", "b"),
         (4, "the cat sat on the mat " * 400, "a"), (5, "Same text", "a"), (6, "Same text", None),
         (5, "Same text", "a"), (None, "日本語 ünï <|endoftext|> <s> <unk>", "a"), (8, " \n\t ", ""),
         (9, "a▁b was not normal", "a"), (10, "x" * 3000, "a"), (11, "tab\tand \x00 nul", "a"),
         (12, "👩‍👩‍👧 ­ﬁ é", "a")]


def test_alignment_equals_a_plain_loop(spark):
    check_alignment(frame(spark, TEXTS), TEXTS)
    assert alignment.statistics(frame(spark, []), A, B).count() == 0


def test_pieces_by_words_equal_whole_texts():
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=B)
    assert alignment._by_words(model)
    texts = [t for _, t, _ in TEXTS if t] + [" ", "  ", "a ", " a", "a  b   c    ", "▁", "a▁b", "x\u00a0y \u3000z", "\n \n"]
    flat, first = alignment.piece_side(B).ids(pa.array(texts, pa.large_string()))
    for k, text in enumerate(texts):
        assert flat[first[k]:first[k + 1]].tolist() == model.encode(text)


def test_links_of_any_vocabulary_are_packed_and_unpacked():
    for top in (0, 40_000, 65_535, 65_536, 2_000_000):
        a, b = np.arange(9, dtype=np.int32) * top // 8, np.arange(9, dtype=np.int32)
        assert [x.tolist() for x in alignment.links_of(alignment.packed_links(a, b))] == [a.tolist(), b.tolist()]
    assert [len(x) for x in alignment.links_of(alignment.packed_links(a[:0], b[:0]))] == [0, 0]


def test_alignment_of_the_whole_table_does_not_depend_on_chunks(spark, monkeypatch):
    documents = spark.read.parquet(f"{TINY}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    check_alignment(documents, rows)
    aligned = alignment.align(documents.repartition(7), A, B).where("chunk % 2 = 0 OR n_links >= 0")
    pairs, scored = alignment.pair_counts(aligned)
    total = aligned.agg(F.sum("n_links")).first()[0]
    unpacked = [alignment.links_of(bytes(r.links)) for r in aligned.select("links").collect()]
    assert scored.agg(F.sum("n")).first()[0] == total == sum(len(b) for _, b in unpacked)
    assert pairs.count() >= scored.count()


# --- decontamination -------------------------------------------------------------

def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_search(texts, items):
    windows = {}
    for name, text in items:
        w = plain_words(text)
        n = min(len(w), 10)
        for p in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[p:p + n]), set()).add(name)
    for text in texts:
        w, hit, names = plain_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[p:p + n]))) is not None:
                    hit.update(range(p, p + n))
                    names |= found
        yield len(w), len(hit), sorted({str(x) for x in names if x is not None})


PASSAGE = " ".join(f"w{k}" for k in range(40))
ITEMS = [("q1", PASSAGE), ("q2", "Short one here"), ("q3", None), ("q4", ""), (None, "nameless item of words"),
         ("q10", PASSAGE), ("q1", "two texts of one item id, of eleven words in all here"), ("q5", "... !!"),
         ("q6", " ".join(f"w{k}" for k in range(30, 55))), ("é", "Ünï cödé ÀB " * 4), ("q7", "a " * 30)]
BODIES = [(1, f"Before {PASSAGE.upper()}, after"), (2, None), (3, ""), (4, " ".join(f"w{k}" for k in range(9))),
          (5, "a short one here, short\none-here"), (6, "x " * 3000 + " ".join(f"w{k}" for k in range(5, 16))),
          (7, " ".join(f"w{k}" for k in range(20, 60))), (8, "nameless item of words"), (9, "w0 w1 w2 w3 w4"),
          (9, "w5 w6 w7 w8 w9"), (None, PASSAGE), (10, "ünï cödé Àb ünï cödé Àb ünï cödé Àb ünï cödé Àb"),
          (11, "a " * 12 + "b " + "a " * 9), (12, "Ünï cödé ÀB " * 9), (1, "..."), (13, "a" * 4000)]


def searched(spark, bodies, items, **options):
    df = frame(spark, [(k, t, "a") for k, t in bodies])
    benchmark = spark.createDataFrame([(k, t, "z") for k, t in items], "item_id string, text string, id string")
    return suffixes.search(df, benchmark, **options)


@pytest.mark.parametrize("part, section, shard", [(suffixes.PART, suffixes.SECTION, suffixes.SHARD), (150, 7, 100)])
def test_search_equals_a_plain_loop(spark, monkeypatch, part, section, shard):
    monkeypatch.setattr(suffixes, "PART", part)
    monkeypatch.setattr(suffixes, "SECTION", section)
    monkeypatch.setattr(suffixes, "SHARD", shard)
    found = searched(spark, BODIES, ITEMS)
    names = found.columns[-4:]
    rows = Counter((r.doc_id, r[names[0]], r[names[1]], tuple(r[names[2]])) for r in found.collect())
    expected = Counter((k, n, h, tuple(i)) for (k, _), (n, h, i) in zip(
        BODIES, plain_search([t for _, t in BODIES], ITEMS)))
    assert rows == expected
    assert "items_" in names  # the frame has a column of the name


def test_longest_matches_and_their_places(spark):
    found = searched(spark, BODIES, ITEMS)
    rows = {r.doc_id: r.matches for r in found.where("doc_id IN (6, 7, 8)").collect()}
    assert [tuple(m) for m in rows[6]] == [("q1", 5, 3000, 11)] or [tuple(m) for m in rows[6]] == [("q10", 5, 3000, 11)]
    assert {(m.item_word, m.word, m.words) for m in rows[7] if m.item in ("q1", "q10")} == {(20, 0, 20)}
    assert [tuple(m) for m in rows[8]] == [(None, 0, 0, 4)]


def test_affected_rows_go_and_the_rest_stays(spark):
    df = frame(spark, [(k, t, "a") for k, t in BODIES])
    benchmark = spark.createDataFrame(ITEMS, "item_id string, text string")
    hits = {k for (k, _), (_, h, _) in zip(BODIES, plain_search([t for _, t in BODIES], ITEMS)) if h}
    left = suffixes.decontaminated(df, benchmark)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {k for k, _ in BODIES} - (hits - {1, 9}) - {None}
    assert left.count() == sum(h == 0 for _, h, _ in plain_search([t for _, t in BODIES], ITEMS))
    assert suffixes.decontaminated(df, benchmark.limit(0)).count() == df.count()
    assert suffixes.search(df.limit(0), benchmark).count() == 0


def test_suffixes_are_sorted_and_long_vocabularies_keep_their_order():
    texts = [" ".join(f"v{k * 7 % 50021}" for k in range(50_021))]
    wanted = suffixes.Wanted(["i"], [0], texts)
    assert wanted.each == 3 and len(wanted.vocabulary) == 50_021
    line, _ = suffixes.numbered(*suffixes.words(pa.array(texts)), wanted.vocabulary)
    shard = suffixes.Shard(line, wanted)
    runs = [shard.line[p:p + 10].tolist() for p in shard.places[::997]]
    assert runs == sorted(runs)
    places, windows = shard.matches(wanted)
    assert sorted(places.tolist()) == list(range(1, 50_021 - 8))
    opens, size = shard.longest(wanted, places, windows)
    assert places[opens].tolist() == [1] and size.tolist() == [50_021]


# --- manifest --------------------------------------------------------------------

def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][k:k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def plain_path(levels, at):
    for level in levels[:-1]:
        low = at // 16 * 16
        run = level[low:low + 16]
        yield "".join(run[:at - low]), "".join(run[at - low + 1:])
        at //= 16


def plain_manifest(rows):
    """Rows of (doc_id, source, lang, n_chars, text)."""
    def leaf(row):
        return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))
    trees = {}
    for row in rows:
        trees.setdefault("" if row[1] is None else "=" + row[1], []).append(row)
    names = sorted(trees, key=lambda x: x.encode())
    levels = {}
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        levels[name] = plain_levels([leaf(r) for r in trees[name]])
    top = plain_levels([levels[n][-1][0] for n in names])
    for at, name in enumerate(names):
        for k, row in enumerate(trees[name]):
            path = [*plain_path(levels[name], k), *plain_path(top, at)]
            node = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
                node = leaf((*row[:4], lowered))
            for left, right in path:
                node = h(left + node + right)
            yield (row[0], leaf(row), levels[name][-1][0], top[-1][0], h("".join(x + y for x, y in path)),
                   node, node == top[-1][0])


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check_manifest(df):
    rows = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = merkle.audited(df)
    assert found.columns == NAMES
    assert Counter(map(tuple, found.collect())) == Counter(plain_manifest(rows))


def test_manifest_of_edge_cases(spark):
    rows = [*TEXTS, (7, "Tie", "a"), (7, "Tied", "a"), (7, "Tie", "a"), (None, None, None), (20, "Élan VITAL", "é")]
    check_manifest(frame(spark, rows))
    check_manifest(frame(spark, [(1, "Alone", None)]))
    check_manifest(frame(spark, [(1, "Two", None), (2, "Two", "")]))
    assert merkle.audited(frame(spark, [])).count() == 0


@pytest.mark.parametrize("size", [15, 16, 17, 256, 257, 4096, 4097, 9000])
def test_manifest_of_one_large_source_and_many_small(spark, size):
    large = spark.range(size).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"))
    small = spark.range(size, size + 40).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"))
    check_manifest(large.union(small).withColumns({
        "lang": F.lit("en"), "n_chars": F.lit(3).cast("long"), "text": F.concat(F.lit("No "), "doc_id")}))


def test_a_tree_attaches_partial_witnesses_and_extends_them():
    leaves = [h(str(k)) for k in range(300)]
    tree = merkle.Tree()
    for leaf in leaves[:3]:
        tree.append(leaf)
    assert tree.witnesses[2] == [[leaves[0] + leaves[1], ""]]  # the siblings so far
    for leaf in leaves[3:]:
        tree.append(leaf)
    assert tree.witnesses[2][0] == [leaves[0] + leaves[1], "".join(leaves[3:16])]
    levels = plain_levels(leaves)
    assert tree.close() == levels[-1][0]
    assert [[tuple(s) for s in w] for w in tree.witnesses] == [list(plain_path(levels, k)) for k in range(300)]
    assert merkle.levels_of(merkle.BLOCK) is None and merkle.levels_of(merkle.BLOCK + 1) == merkle.LEVELS

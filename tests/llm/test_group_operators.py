"""Near-duplicates, embeddings, personal data, preferences, site lines and the pipeline."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from checks.compare import connect, differences  # noqa: E402
from factorloom.llm import (chat, embedding_dedup, frames, line_dedup, near_dedup, packing, pii,  # noqa: E402
                            queries)
from tests.conftest import SMALL, TINY  # noqa: E402

LONG = "word " * 4000 + "tail " * 3


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def partition(labels):
    """Which keys share a class, as a set of sets."""
    groups = {}
    for key, label in labels.items():
        groups.setdefault(label, set()).add(key)
    return {frozenset(g) for g in groups.values()}


def joined(keys, links):
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}


# --- SQL -------------------------------------------------------------------------

@pytest.mark.parametrize("folder", [TINY, SMALL])
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name, folder):
    rows, bad, example = differences(queries.QUERIES[name](spark, folder), connect(folder), queries.ORACLES[name])
    assert rows > 0 and bad == 0, example


def test_driver_registers_every_operator_once():
    import __spark_entry__ as driver
    numbered = Counter(re.match(r"op(\d+)_", n)[1] for n in driver.queries() if n.startswith("op"))
    assert numbered == {str(k): 1 for k in range(1, 14)} and "pipeline" in driver.queries()


# --- components ------------------------------------------------------------------

def test_components_equal_union_find(spark):
    rng = np.random.default_rng(4)
    for shape in ("random", "chain", "star"):
        if shape == "random":
            links = [tuple(map(int, p)) for p in rng.integers(0, 300, (200, 2))]
        elif shape == "chain":
            links = [(k, k + 1) for k in range(90)]
        else:
            links = [(500, k) for k in range(400)]
        found = {r.node: r.component for r in frames.components(
            spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
        keys = {k for p in links if p[0] != p[1] for k in p}
        assert found == joined(keys, [p for p in links if p[0] != p[1]])
    assert frames.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# --- near-duplicates -------------------------------------------------------------

def all_links(texts):
    """All pairs of different word sequences, with weights from the documents themselves."""
    found, counts, first, digests = near_dedup.vectors(pa.array([t or "" for _, t in texts]), True)
    values, frequency = np.unique(found, return_counts=True)
    frequency = np.maximum(frequency[np.searchsorted(values, found)], len(texts) / near_dedup.RARE)
    weights = counts * np.log1p(len(texts) / frequency)
    own = [(found[p:q], weights[p:q]) for p, q in zip(first[:-1], first[1:])]
    sums = np.array([w.sum() for _, w in own])
    content = {}
    for k, d in enumerate(digests):
        content.setdefault(d, []).append(k)
    links = [(texts[g[0]][0], texts[k][0]) for g in content.values() for k in g[1:]]
    heads = sorted((g[0] for g in content.values()), key=lambda k: sums[k])
    holds = {}  # a pair at the threshold shares most of its weight, so some shingle
    for at, k in enumerate(heads):
        near = {x for s in own[k][0].tolist() for x in holds.get(s, ()) if sums[x] >= near_dedup.THRESHOLD * sums[k] * .999}
        links += [(texts[k][0], texts[x][0]) for x in near if near_dedup.similarity(own[k], own[x]) >= near_dedup.THRESHOLD]
        for s in own[k][0].tolist():
            holds.setdefault(s, []).append(k)
    return links


def test_near_duplicates_of_the_whole_table_equal_all_pairs(spark, documents):
    """Decisions with true document frequencies; banding may miss a pair at the threshold once in 5,000."""
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    expected = joined([k for k, _ in texts], all_links(texts))
    assert {r.id: r.class_id for r in near_dedup.classes(documents).collect()} == expected
    assert len(set(expected.values())) < len(texts)


def test_weights_follow_true_document_frequencies(spark, documents, monkeypatch):
    monkeypatch.setattr(near_dedup, "RARE", 100)
    weights = near_dedup.inverse_frequencies(documents.select("text"))
    texts = [r.text or "" for r in documents.select("text").collect()]
    found = near_dedup.vectors(pa.array(texts))[0]
    values, frequency = np.unique(found, return_counts=True)
    np.testing.assert_allclose(weights.of(values), np.log1p(len(texts) / np.maximum(frequency, len(texts) / 100)), rtol=1e-6)
    assert len(weights.shingles) == (frequency * 100 >= len(texts)).sum() <= 100 * len(found) / len(texts)


def test_different_texts_of_one_id_stay_apart(spark):
    long = " ".join(f"a{k}" for k in range(60))
    rows = [(7, long), (7, "quite another text " + " ".join(f"b{k}" for k in range(50))), (8, long + " end"), (None, long),
            (None, "only here without an id, twice"), (None, "only here without an id, twice"), (9, "same"), (9, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.id, bytes(r.digest)): r.class_id for r in near_dedup.classes(df).collect()}
    assert sorted(map(str, found.values())) == ["7", "7", "7", "7", "9", "None"]  # contents by id
    kept = sorted(((r.doc_id or 0, r.text) for r in near_dedup.deduplicated(df).collect()))
    assert kept == sorted([(0, rows[4][1]), (7, long), (7, rows[1][1]), (9, "same")])


def test_a_chain_of_many_texts_moves_each_body_a_bounded_number_of_times(spark, monkeypatch):
    """Every text is half like the next one, so buckets hang together but hold few texts each."""
    sent = []
    own = near_dedup._round

    def counted(*arguments):
        monkeypatch.setattr(near_dedup, "materialize", lambda df, name="step": (
            sent.append(kept(df, name)) or sent[-1]))
        return own(*arguments)

    from factorloom.session import materialize as kept
    monkeypatch.setattr(near_dedup, "_round", counted)
    rows = [(k, " ".join(f"w{i}" for i in range(k * 18, k * 18 + 60))) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = near_dedup.classes(df)
    assert found.where("id <> class_id").isEmpty()
    alike = [x for x in sent if "marks" in x.columns]
    assert len(alike) == 2 and sum(x.count() for x in alike) <= 16 * len(rows)


def test_a_large_group_of_near_copies_is_divided_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = np.random.default_rng(7)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(120):
        words = list(base)
        for at in rng.choice(150, 4, replace=False):
            words[at] = f"x{k}_{at}"
        rows.append((k, " ".join(words)))
    rows += [(k, " ".join(f"y{k}_{i}" for i in range(80))) for k in range(200, 260)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = joined([k for k, _ in rows], all_links(rows))
    assert {r.id: r.class_id for r in near_dedup.classes(df).collect()} == expected


def test_samples_agree_as_often_as_the_weighted_jaccard_similarity():
    rng = np.random.default_rng(2)
    common, mine, theirs = (rng.integers(1, 2**63, n).astype(np.uint64) for n in (400, 60, 100))
    agreed, true = [], []
    for seed in range(20):
        w = np.random.default_rng(seed).exponential(1, 560) + 0.1
        a = np.sort(np.concatenate((common, mine)) + np.uint64(seed))
        b = np.sort(np.concatenate((common, theirs)) + np.uint64(seed))
        weight = dict(zip(np.concatenate((common, mine, theirs)) + np.uint64(seed), w))
        wa, wb = (np.array([weight[x] for x in s]) for s in (a, b))
        true.append(near_dedup.similarity((a, wa), (b, wb)))
        made = near_dedup.samples(np.concatenate((a, b)), np.concatenate((wa, wb)).astype(np.float32),
                                  np.array([0, len(a), len(a) + len(b)]))
        agreed.append((made[0] == made[1]).mean())
    assert abs(np.mean(agreed) - np.mean(true)) < 0.03


def test_near_duplicates_of_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " .. "), (4, "one two"), (5, "One, two!"), (5, "One, two!"), (6, LONG),
            (7, LONG + "end"), (None, "one two"), (8, "two one")]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, id int, body int")
    found = [(r.id, r.class_id) for r in near_dedup.classes(df).collect()]
    assert sorted(((k or 0), c) for k, c in found) == [
        (0, 4), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (6, 6), (7, 6), (8, 8)]
    assert near_dedup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- embeddings ------------------------------------------------------------------

def check_embeddings(rows, found):
    usable = [(k, np.array(v, float), lab) for k, v, lab in rows]
    keys = [k for k, _, _ in usable]
    links = []
    for i, (a, x, p) in enumerate(usable):
        for b, y, q in usable[:i]:
            if p == q and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                links.append((a, b))
    degree = Counter(k for pair in links for k in pair)
    assert {k: r.n_links for k, r in found.items()} == {k: degree[k] for k in keys}
    assert {k: r.component_id for k, r in found.items()} == joined(keys, links)
    assert all(r.kept == (k == r.component_id) for k, r in found.items())
    return len(links)


def test_embeddings_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    rng = np.random.default_rng(9)
    rows = []
    centre = rng.normal(size=16)
    for k in range(150):  # a large group, some of it exact copies
        rows.append((k, (centre + rng.normal(size=16) * 0.08).astype(np.float32).tolist(), 1))
    rows += [(150 + k, rows[0][1], 1) for k in range(30)]
    for k in range(200, 320):
        rows.append((k, rng.normal(size=16).astype(np.float32).tolist(), int(k % 3)))
    rows += [(400 + k, [2 * x for x in rows[200 + k][1]], rows[200 + k][2]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: r for r in embedding_dedup.link(df).collect()}
    assert check_embeddings(rows, found) > 1000


@pytest.mark.parametrize("partitions", [8, 400])
def test_pairs_in_a_dense_label_of_100000_vectors_are_found(spark, partitions):
    """Vectors whose mean cosine is 0.8, and pairs of them planted at about 0.983."""
    random = np.random.default_rng(12)
    n, size, planted = 100_000, 64, 2_000
    vectors = random.standard_normal((n, size)) / size ** .5
    vectors = vectors * .2 ** .5 + np.eye(size)[0] * .8 ** .5
    step = random.standard_normal((planted, size)) / size ** .5
    length = np.linalg.norm(vectors[:planted], axis=1, keepdims=True)
    vectors[n - planted:] = vectors[:planted] + step * length * (1 / .983 ** 2 - 1) ** .5
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    truth = np.einsum("ij,ij->i", unit[:planted], unit[n - planted:]) >= .98
    assert truth.sum() > .8 * planted
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(vectors.ravel()))
    table = pa.table({"vec_id": np.arange(n), "label": ["dense"] * n, "embedding": lists})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = embedding_dedup.link(spark.createDataFrame(table).repartition(8))
        rows = {r.vec_id: r for r in found.where("n_links > 0").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    hit = [k for k in np.flatnonzero(truth).tolist()
           if k in rows and n - planted + k in rows and rows[k].component_id == rows[n - planted + k].component_id]
    assert len(hit) >= .99 * truth.sum()
    assert len(rows) >= 2 * len(hit) and set(rows) <= {*range(planted), *range(n - planted, n)}
    DENSE.append({k: (r.n_links, r.component_id) for k, r in rows.items()})
    assert DENSE[0] == DENSE[-1]  # whatever the partitions


DENSE: list[dict] = []


def test_embeddings_of_edge_cases(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [1.0, None], 1),
            (6, [float("nan"), 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 2), (9, [1.0, 0.0, 0.0], 1),
            (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (10, [], 1), (11, [float("inf"), 0.0], 1)]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows],
                               "vec_id long, embedding array<float>, label int, id int, n_links int")
    found = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup.link(df).collect()),
                   key=str)
    linked = [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    alone = [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert found == sorted([*linked, *alone, (0, 0, None, False)], key=str)
    assert embedding_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# --- personal data ---------------------------------------------------------------

PERSONAL = [
    (1, "Mail a.Bc9@mail5.example.com or A.BC9@MAIL5.EXAMPLE.COM, call +1 (743) 555-3824 / +1-743-555-3824."),
    (2, "Card 4111 1111 1111 1111 and 4111111111111111, no card 9870157079875996. 10.1.2.3, 8.196.197.208"),
    (3, "Mr. John Smith met Frau Müller and Mrs Smith. Dr. Anna Brown, Госпожа Иванова. Mary Jones."),
    (4, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ssn 123-45-6789 DE89 3704 0044 0532 0130 00'),
    (5, "Plain text, 2020-10-10, version 1.2.3, 12345."), (6, None), (7, ""), (5, "repeated 8.196.197.208"),
    (5, "repeated 8.196.197.208"), (None, "müß@straße-mail.org " + LONG)]


def replaced(spark, rows, **options):
    df = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in rows],
                               "doc_id long, text string, shown string, key_1 int, n_entities int")
    return pii.replace(df, **options)


def test_surrogates_keep_kind_format_and_identity(spark):
    out = replaced(spark, PERSONAL)
    assert out.columns == ["doc_id", "text", "shown", "key_1", "n_entities", "n_entities_"]
    rows = out.collect()
    assert len(rows) == len(PERSONAL)
    text = {r.doc_id: r.text for r in rows if r.doc_id != 5}
    lower, upper = re.findall(r"\S+@\S+?(?=[ ,])", text[1])
    assert lower.upper() == upper and lower != "a.Bc9@mail5.example.com" and lower.endswith(".example.com")
    one, two = re.search(r"call (\+1 \(\d{3}\) 555-\d{4}) / (\+1-\d{3}-555-\d{4})\.", text[1]).groups()
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two) != "17435553824"
    spaced, plain = re.search(r"Card (\d{4} \d{4} \d{4} \d{4}) and (\d{16}),", text[2]).groups()
    assert spaced.replace(" ", "") == plain != "4111111111111111" and plain[0] == "4" and luhn(plain)
    assert "no card 9870157079875996" in text[2] and re.search(r"10\.\d+\.\d+\.\d+, (\d+\.){3}\d+$", text[2])
    name = re.match(r"Mr\. (\w+) (\w+) met Frau (\w+) and Mrs (\w+)\. Dr\. (\w+) (\w+), Госпожа ([а-яА-Я]+)\. (\w+) ", text[3])
    assert name[2] == name[4] and "Smith" not in text[3] and "Иванова" not in text[3]
    assert name[1][-1] not in "ae" and name[8][-1] in "ae"  # gender of given names
    assert not re.search("24be64|123-45-6789|DE89 3704", text[4]) and re.search(r"ssn \d{3}-\d{2}-\d{4} DE\d\d \d{4}", text[4])
    assert iban(re.search(r"DE[\d ]+", text[4])[0].replace(" ", ""))
    assert (text[6], text[7]) == (None, "")
    fives = [r.text for r in rows if r.doc_id == 5]
    assert PERSONAL[4][1] in fives and len(set(fives)) == 2
    assert {re.search(r"(\d+\.){3}\d+$", t)[0] for t in fives if "repeated" in t} == {text[2].split(", ")[-1]}
    assert text[None].endswith(LONG) and "straße" not in text[None]
    assert {r.doc_id: r.n_entities_ for r in rows if r.doc_id in (1, 2, 6, 7)} == {1: 4, 2: 4, 6: 0, 7: 0}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(value):
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def test_surrogates_depend_on_the_key_and_repeat(spark):
    def texts(**options):
        return sorted(r.text or "" for r in replaced(spark, PERSONAL, **options).collect())
    assert texts(key="a") == texts(key="a") != texts(key="b")


def test_distinct_entities_stay_distinct_and_none_is_an_entity(spark):
    """Few values are free, so that first offers collide and hit real entities."""
    values = [f"127.{a}.{b}.{c}" for a in range(4) for b in range(4) for c in range(1, 30)]
    values += [f"+1{n:03d}555{m:04d}" for n in range(10) for m in range(100)]
    kinds = ["ip" if v[0] == "1" else "phone" for v in values]
    df = spark.createDataFrame(list(zip(kinds, values)), "kind string, value string")
    found = pii.assign(df, "k").collect()
    assert len(found) == len(values) == len({(r.kind, r.surrogate) for r in found})
    assert not {r.surrogate for r in found} & set(values)


def test_collisions_are_resolved(spark, monkeypatch):
    real = pii._surrogate
    monkeypatch.setattr(pii, "_surrogate", lambda kind, value, turn, key: F.concat(
        F.lit("s"), F.pmod(F.xxhash64(value, turn), F.lit(60)).cast("string")))
    df = spark.createDataFrame([("x", f"v{k}") for k in range(30)] + [("x", "s7")], "kind string, value string")
    found = pii.assign(df, "k").collect()
    assert len({r.surrogate for r in found}) == 31 and "s7" not in {r.surrogate for r in found}
    monkeypatch.setattr(pii, "_surrogate", lambda kind, value, turn, key: F.lit("s"))
    with pytest.raises(ValueError):
        pii.assign(df, "k").collect()
    monkeypatch.setattr(pii, "_surrogate", real)


def test_cards_beside_other_numbers_are_replaced(spark):
    """An expiry date, a security code and numbers before a card stay and do not hide it."""
    card, other = "4111111111111111", "378282246310005"
    texts = ["Card 4111 1111 1111 1111 12/27", f"{card} 123", f"on 12 {card}", f"2027 4111-1111-1111-1111 {other}.",
             "3782 822463 10005 1234 or 4111 1111 1111 1111 2nd", f"no 9870157079875996 12, {card} 10.1.2.3",
             f"{card} 123-45-6789", "1 2 3 4 5 6 7 8 9 10 11 12 13 14"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.replace(df).collect()}
    new = re.search(r"\d{16}", out[1].text)[0]
    also = re.search(r"(\d{15})\.", out[3].text)[1]
    assert luhn(new) and luhn(also) and new != card and also != other
    spaced, hyphened = (sep.join(new[k:k + 4] for k in (0, 4, 8, 12)) for sep in " -")
    assert out[0].text == f"Card {spaced} 12/27" and out[1].text == f"{new} 123" and out[2].text == f"on 12 {new}"
    assert out[3].text == f"2027 {hyphened} {also}."
    assert out[4].text == f"{also[:4]} {also[4:10]} {also[10:]} 1234 or {spaced} 2nd"
    assert re.fullmatch(rf"no 9870157079875996 12, {new} 10\.\d+\.\d+\.\d+", out[5].text) and "10.1.2.3" not in out[5].text
    assert out[6].text.startswith(new) and "123-45-6789" not in out[6].text and out[7].text == texts[7]
    assert [out[k].n_entities for k in range(8)] == [1, 1, 1, 2, 2, 2, 2, 0]


def test_names_that_stand_alone_follow_the_marked_ones(spark):
    texts = ["Mary Johnson spoke. Johnson said hi, JOHNSON's dog and Mary left; Johnsonville stays.",
             "Dr. Ann Smith-Jones met Mr. O'Brien, Mrs McDonald and Jean-Pierre Dupont. Smith-Jones, Smith and O'Brien.",
             "Mr Brown saw a brown bear. Brown bears sleep.", "Johnson and Mary without a mark.",
             "Mr. John came. John Smith and Dr. John Smith; Frau Johnson, Herr Johnson, Johnson-Meier."]
    # Many names in one long text, each of them alone once more.
    names = ["".join(random.Random(k).choices("bcdfghklmnprst", k=6)).capitalize() for k in range(400)]
    texts.append(" ".join(f"Mr {n} is here." for n in names) + " x" * 20000 + " " + " ".join(f"{n}, again" for n in names))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.replace(df).collect()}
    first, last, one, caps, given = re.fullmatch(
        r"(\w+) (\w+) spoke\. (\w+) said hi, (\w+)'s dog and (\w+) left; Johnsonville stays\.", out[0].text).groups()
    assert one == last != "Johnson" and caps == last.upper() and given == first != "Mary" and first[-1] in "ae"
    whole, irish, scot, french, again, smith, also = re.fullmatch(
        r"Dr\. \w+ (\w+) met Mr\. (\w+), Mrs (\w+) and \w+ (\w+)\. (\w+), (\w+) and (\w+)\.", out[1].text).groups()
    assert again == whole and also == irish and smith == "Smith" and len({whole, irish, scot, french}) == 4
    assert not re.search("Ann|Jones|Brien|Donald|Jean|Pierre|Dupont", out[1].text)
    assert re.fullmatch(r"Mr (?!Brown)\w+ saw a brown bear\. Brown bears sleep\.", out[2].text)
    assert out[3].text == texts[3]
    m = re.fullmatch(r"Mr\. (\w+) came\. (\w+) (\w+) and Dr\. (\w+) (\w+); Frau (\w+), Herr (\w+), Johnson-Meier\.",
                     out[4].text)
    assert m[2] == m[4] != "John" and m[3] == m[5] != "Smith" and m[6] == m[7] == last and m[1] != "John"
    marked, alone = re.findall(r"Mr (\w+) is", out[5].text), re.findall(r"(\w+), again", out[5].text)
    assert marked == alone and len(set(alone)) == len(set(names)) and not set(alone) & set(names)
    assert [out[k].n_entities for k in range(6)] == [4, 6, 1, 0, 5, 800]


def test_formats_with_too_few_values_are_widened(spark, monkeypatch):
    monkeypatch.setattr(pii, "WIDE", 1)  # fewer turns that cannot succeed
    mails = [("email", f"{c}@example.com") for c in "abcdefghijklmnopqrstuvwxyz"]
    found = pii.assign(spark.createDataFrame(mails, "kind string, value string"), "k").collect()
    assert sorted((r.kind, r.value) for r in found) == mails
    assert len({r.surrogate for r in found}) == 26
    assert all(re.fullmatch(r"[a-z]{2,}@example\.com", r.surrogate) for r in found)
    df = spark.createDataFrame([("ip", "192.168.3.4"), ("phone", "+12345")], "k string, v string").coalesce(1)
    address, phone = [r[0] for r in df.select(pii._surrogate(F.col("k"), F.col("v"), F.lit(23), "k")).collect()]
    assert 240 <= int(address.split(".")[0]) <= 255 and re.fullmatch(r"\+1\d{27}", phone)
    shown = spark.createDataFrame([("phone", "+1 23 45", "+198765")], "k string, s string, v string").select(
        pii._written(F.col("k"), F.col("s"), F.col("v"))).first()[0]
    assert shown == "+1 98 765"


def test_surrogates_over_the_documents(spark, documents):
    out = queries.op7_pii_surrogates(spark, SMALL).join(
        documents.select("doc_id", F.col("text").alias("before")), "doc_id")
    rows = pii.entities(pii.entities(out, "before", "old"), "text", "new").collect()
    mapping, kept = {}, 0
    for row in rows:
        assert len(row.old) == len(row.new)
        for a, b in zip(row.old, row.new):
            kept += a == b
            assert mapping.setdefault(a, b) == b
        if not row.old:
            assert row.text == row.before
    assert sum(r.n_entities for r in rows) + kept == sum(len(r.old) for r in rows) > 80
    assert all(re.fullmatch(r"\d{16}", a) for a, b in mapping.items() if a == b)  # numbers that are no cards
    assert len(set(mapping.values())) == len(mapping)
    assert replaced(spark, []).count() == 0


# --- preferences -----------------------------------------------------------------

def test_preferences_of_edge_cases(spark):
    rows = [(1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes"),
            (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no"), (1, "rejected", 2, "user", "?"),
            (2, "chosen", 0, None, None), (2, "chosen", 0, None, None), (2, "rejected", 0, None, ""),
            (2, "rejected", 0, None, None), (3, "chosen", 5, "user", "alone"), (None, "chosen", 0, "user", "x"),
            (4, "chosen", 1, "assistant", LONG), (4, "rejected", None, "system", "s"), (4, "rejected", 1, "assistant", LONG)]
    df = spark.createDataFrame([(*r, 1) for r in rows],
                               "pair_id long, side string, turn int, role string, text string, prompt int")
    found = {r.pair_id: r for r in chat.format_preferences(df).collect()}
    assert set(found) == {1, 2, 3, 4}
    assert found[1].prompt == "<|user|>\nhi\n<|end|>\n" and found[1].common_turns == 1
    assert found[1].chosen_completion == "<|assistant|>\nyes\n<|end|>\n"
    [span] = found[1].rejected_trained
    assert found[1].rejected_completion[span.start:span.end] == "no\n<|end|>\n" and found[1].rejected_turns == 2
    assert found[2].common_turns == 1 and found[2].chosen_completion == found[2].rejected_completion == "<|unknown|>\n\n<|end|>\n"
    assert (found[3].prompt, found[3].rejected_completion, found[3].rejected_trained) == ("", "", [])
    assert found[4].common_turns == 0 and LONG in found[4].chosen_completion
    assert chat.format_preferences(df.where("false")).count() == 0
    assert chat.swapped_answers(spark.createDataFrame([(None, None, None, None), (1, None, "assistant", None)],
                                                      "conv_id long, turn int, role string, text string")).count() == 1


# --- site lines ------------------------------------------------------------------

def test_site_lines_of_edge_cases(spark):
    rows = [(f"h{k % 2}", f"menu\nown line {k}\n\n menu \n{'foot' if k % 4 == 0 else 'end'}") for k in range(20)]
    rows += [(None, "menu\nx"), ("h0", None), ("h1", ""), ("small", "menu\nx"), ("small", "menu\nx"), ("h0", LONG)]
    df = spark.createDataFrame([(h, t, 1, 2, 3) for h, t in rows],
                               "host string, text string, site int, line_keys int, lines_removed int")
    out = line_dedup.drop_boilerplate(df, "host", "text")
    assert out.columns == [*df.columns, "lines_removed_"]
    got = Counter((r.host, r.text, r.lines_removed_) for r in out.collect())
    expected = Counter()
    for k, (h, t) in enumerate(rows[:20]):
        if h == "h0":  # menu on 10 of 12 pages, foot on 5 of 12, end on 5 of 12
            expected[(h, f"own line {k}\n", 3)] += 1
        else:
            expected[(h, f"own line {k}\n", 3)] += 1
    expected.update([(h, t, 0) for h, t in rows[20:]])
    assert got == expected
    assert line_dedup.drop_boilerplate(df.where("false"), "host", "text").count() == 0


def test_ratio_is_relative_to_the_site(spark):
    rows = [("big", f"line {k}\nshared") for k in range(10)] + [("big", f"other {k}") for k in range(60)]
    rows += [("little", f"text {k}\nshared") for k in range(10)]
    out = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "host string, text string"), "host", "text")
    left = {r.host: r.n for r in out.groupBy("host").agg(F.sum("lines_removed").alias("n")).collect()}
    assert left == {"big": 0, "little": 10}


def test_visible_lines_of_a_page(spark):
    html = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head>"
            "<body><nav><a href='/'>Home</a></nav><!-- c --><p>One <b>two</b> &amp; three<br>four</p>\n\n<p>five</p></body></html>")
    row = spark.createDataFrame([(html, "https://u@Www.Ex.org:80/x?y"), (None, None), ("", "no url")], "h string, u string") \
        .select(line_dedup.html_lines(F.col("h")).alias("h"), line_dedup.url_host(F.col("u")).alias("u")).collect()
    assert row[0].h.split("\n") == ["Home", "One two & three", "four", "five"] and row[0].u == "www.ex.org"
    assert tuple(row[1]) == (None, None) and tuple(row[2]) == ("", None)


# --- pipeline --------------------------------------------------------------------

def test_pipeline_stage_by_stage(spark, documents, tmp_path):
    """Each stage against a plain computation over what the stage before has kept."""
    docs, labels = documents, spark.read.parquet(f"{SMALL}/labels.parquet").toPandas().set_index("doc_id")
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        results[name] = docs
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "quality":
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            known = labels.quality.groupby(level=0).max()
            assert np.mean([k in kept for k, q in known.items() if q]) > .98
            assert np.mean([k not in kept for k, q in known.items() if not q]) > .9
        if name == "lines":
            pages = [(r.doc_id, r.source, r.text) for r in before.collect()]
            hosts = Counter(s for _, s, _ in pages)
            seen = Counter((s, x) for _, s, t in pages for x in {y.strip(" ") for y in t.split("\n")} - {""})
            bad = {k for k, n in seen.items() if n / hosts[k[0]] > line_dedup.MAX_RATIO and n >= line_dedup.DOCUMENT_LEAST}
            expected = {(k, "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in bad)) for k, s, t in pages}
            assert {(r.doc_id, r.text) for r in docs.collect()} == expected
        if name == "near_duplicates":
            texts = [(r.doc_id, r.text) for r in before.collect()]
            found = {r.id: r.class_id for r in near_dedup.classes(before).collect()}
            assert {r.doc_id for r in docs.collect()} == {k for k, c in found.items() if k == c}
            assert 0 < docs.count() < len(texts)
        if name == "surrogates":
            rows = docs.join(before.select("doc_id", F.col("text").alias("before")), "doc_id").select(
                "text", "before", pii.find("before").alias("old")).collect()
            assert len(rows) == before.count()
            for row in rows:
                assert not any(x in row.text for x in row.old if "@" in x or "." in x)
                assert row.old or row.text == row.before
    packed = results["packing"]
    assert packed.agg(F.sum("length")).first()[0] == packed.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    lengths = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in lengths) <= packing.CAPACITY


def test_planted_lines_leave_the_documents_and_clean_ones_stay(spark):
    """Two lines on 4 and 1 % of a source's documents go; rarer lines and those of copies stay."""
    def own(k, n=6):
        return [f"own line {i} of text {k}" for i in range(n)]
    rows = []
    for k in range(3000):
        lines = own(k)
        lines[3:3] = ["planted often"] * (k % 25 == 0) + ["planted now and then", "and its second line"] * (k % 100 == 7)
        lines += ["seen rarely"] * (k % 300 == 1)
        rows.append((k, lines))
    rows += [(3000 + k, own("copied", 9)) for k in range(60)]  # copies, and copies with an own line
    rows += [(3100 + k, [*own("edited", 9), f"edit {k}"]) for k in range(60)]
    docs = spark.createDataFrame([(k, "\n".join(x), "en", "s", 1) for k, x in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.site_lines(spark, docs, SMALL).collect()}
    planted = {"planted often", "planted now and then", "and its second line"}
    assert found == {k: [x for x in lines if x not in planted] for k, lines in rows}


def test_pipeline_of_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "A fine text of words.", None, None, 21),
            (3, "A fine text of words.", None, None, 21), (None, "A text without id, of words.", "en", "s", 5),
            (4, LONG, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.where("false")):
        kept = [frame]
        for name, stage in corpus_pipeline.STAGES[1:]:
            kept.append(stage(spark, kept[-1], SMALL))
            kept[-1].collect()
        if frame is docs:
            assert kept[2].where("doc_id = 3").count() == 1 and kept[2].where("doc_id IS NULL").count() == 1
        else:
            assert kept[-1].count() == 0
    assert corpus_pipeline.quality_filter(spark, docs, SMALL).columns == list(corpus_pipeline.COLUMNS)


def test_pipeline_runs_as_one_query(spark):
    assert corpus_pipeline.run(spark, TINY).count() > 0

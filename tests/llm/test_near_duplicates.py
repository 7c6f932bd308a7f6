import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cohortry.llm import grams, near_duplicates
from cohortry.llm.near_duplicates import classes, deduplicated, gamma_tables, samples
from tests.conftest import SMALL
from tests.llm.edges import WORDS, awkward, documents, nothing, same_schema
from tests.llm.test_grams import thue_morse

FOLD = {i: i + 32 for i in range(65, 91)}


def brute(rows, least=0.8):
    """Classes by the weighted Jaccard similarity of all pairs with a shared shingle."""
    words = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD)) for i, t in rows}

    def runs(ws):
        length = min(len(ws), 5)
        return Counter(tuple(ws[i : i + length]) for i in range(len(ws) - length + 1)) if ws else {}

    held = {i: runs(ws) for i, ws in words.items()}
    frequency = Counter(s for counts in held.values() for s in counts)
    most = len(words) + 1
    rarity = {s: np.log(most / (max(n, len(words) / 256) + 1)) + 1 for s, n in frequency.items()}
    weights = {i: {s: n * rarity[s] for s, n in counts.items()} for i, counts in held.items()}
    holders = defaultdict(list)
    for i, held in weights.items():
        for shingle in held:
            holders[shingle].append(i)
    parent = {i: i for i in words}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in {(a, b) for held in holders.values() for a in held for b in held if a < b}:
        x, y = weights[a], weights[b]
        shared = sum(min(x[s], y[s]) for s in x if s in y)
        if shared >= least * (sum(x.values()) + sum(y.values()) - shared):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {i: root(i) for i in words}


def test_given_documents_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"]: r["class_id"] for r in classes(docs).collect()} == expected


def test_families_of_edited_copies(spark):
    """Random edits of a few originals, far from the threshold on either side."""
    draw = random.Random(5)
    rows, family = [], {}
    for number in range(6):
        original = draw.choices(WORDS, k=300)
        for copy in range(12):
            words = list(original)
            for _ in range(0 if copy < 3 else draw.randint(1, 3)):
                words[draw.randrange(len(words))] = f"new{draw.random()}"
            doc_id = len(rows)
            rows.append((doc_id, " ".join(words), "s"))
            family[doc_id] = number * 12
    found = {r["doc_id"]: r["class_id"] for r in classes(documents(spark, rows)).collect()}
    assert found == family


def test_samples_agree_as_often_as_documents_are_similar():
    draw = np.random.default_rng(1)
    shingles = draw.integers(0, 1 << 63, 400).astype(np.uint64)
    left, right = draw.uniform(0.5, 5, 400), draw.uniform(0.5, 5, 400)
    left[300:], right[:100] = 0, 0
    expected = np.minimum(left, right).sum() / np.maximum(left, right).sum()
    count, tables = 3000, gamma_tables()
    each = [samples(shingles[w > 0], w[w > 0], np.array([0]), count, tables)[0] for w in (left, right)]
    assert np.mean(each[0] == each[1]) == pytest.approx(expected, abs=4 * np.sqrt(0.25 / count))


def test_gamma_quantiles():
    x = gamma_tables()[0].astype(float)
    wanted = (np.arange(len(x)) + 0.5) / len(x)
    assert np.abs(1 - (1 + x) * np.exp(-x) - wanted).max() < 1e-6 and (np.diff(x) >= 0).all()


def test_awkward_rows(spark):
    rows = sorted((r["doc_id"] or -1, r["class_id"]) for r in classes(awkward(spark)).collect())
    assert rows == [(-1, None), (1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (7, 7), (9, 9), (10, 10)]
    assert classes(nothing(spark)).count() == 0


def test_one_document_of_each_class_stays(spark):
    docs = awkward(spark)
    kept = deduplicated(docs)
    assert same_schema(kept, docs)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 7, 9, 10]
    assert deduplicated(nothing(spark)).count() == 0


def test_one_doc_id_with_two_texts_is_two_documents(spark):
    a, b, c = (" ".join(WORDS[at : at + 100]) for at in (0, 100, 200))
    docs = documents(spark, [(1, a, "s"), (2, b, "s"), (3, a, "s"), (3, b, "s"), (3, c, "s")])
    found = sorted((r["doc_id"], r["class_id"]) for r in classes(docs).collect())
    assert found == [(1, 1), (2, 2), (3, 1), (3, 2), (3, 3)]
    kept = sorted((r["doc_id"], r["text"]) for r in deduplicated(docs).collect())
    assert kept == [(1, a), (2, b), (3, c)]


def test_two_texts_of_one_doc_id_in_one_class(spark):
    a = WORDS[:200]
    b = [*a[:150], "other", *a[151:]]
    docs = documents(spark, [(5, " ".join(a), "s"), (5, " ".join(b), "s"), (5, " ".join(b), "t")])
    kept = [[r["text"] for r in deduplicated(docs).collect()] for _ in range(2)]
    assert len(kept[0]) == 1 and kept[0] == kept[1]


def test_words_that_only_a_better_hash_tells_apart(spark):
    left, right = thue_morse(2048)
    rows = [(1, " ".join([left] + WORDS[:4]), "s"), (2, " ".join([right] + WORDS[:4]), "s")]
    assert {r["class_id"] for r in classes(documents(spark, rows)).collect()} == {1, 2}


def test_very_long_texts(spark):
    words = [f"w{i}" for i in range(150_000)]
    rows = [(1, " ".join(words), "s"), (2, " ".join([*words, "more"]), "s"), (3, "a b c", "s")]
    assert {r["doc_id"]: r["class_id"] for r in classes(documents(spark, rows)).collect()} == {1: 1, 2: 1, 3: 3}


def test_frequencies_are_exact_above_the_floor(spark):
    draw = random.Random(2)
    texts = [" ".join(draw.choices("abcdefgh", k=12)) for _ in range(300)]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    found = near_duplicates.rarities(docs, 2, 1 / 20, 16)
    counts = Counter(s for t in texts for s in set(zip(t.split(), t.split()[1:], strict=False)))
    wanted = sorted(np.log(301 / (n + 1)) + 1 for n in counts.values() if n > 15)
    assert sorted(found.values.tolist()) == pytest.approx(wanted) and len(wanted) > 3
    assert found.others == pytest.approx(np.log(301 / 16) + 1) and (np.diff(found.shingles.view(np.int64)) != 0).all()


def test_a_large_bucket_is_one_class_without_all_pairs(spark):
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(600):
        words = list(base)
        words[i % 400] = f"x{i}"
        rows.append((i, " ".join(words), "s"))
    assert classes(documents(spark, rows)).where("class_id = 0").count() == 600


def test_small_classes_in_large_buckets_of_one_template(spark):
    """Pairs above the limit among many documents that are alike, but below it."""
    template = [f"t{i}" for i in range(300)]
    rows = []
    for number in range(200):
        shared = [f"c{number}x{i}" for i in range(3)]
        for _ in range(2):
            own = [f"d{len(rows)}x{i}" for i in range(5)]
            rows.append((len(rows), " ".join(template[:150] + shared + template[150:] + own), "s"))
    expected = brute([(i, t) for i, t, _ in rows])
    assert len(set(expected.values())) == 200
    found = {r["doc_id"]: r["class_id"] for r in classes(documents(spark, rows)).collect()}
    assert found == expected


def test_chains_and_rings_are_joined(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102)]
    labels = near_duplicates.components(spark.createDataFrame(edges, "low long, high long"))
    found = {r["node"]: r["label"] for r in labels.collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("shape", ["path", "random", "star"])
def test_components_of_any_shape(spark, shape):
    draw = random.Random(3)
    edges = {
        "path": [(i, i + 1) for i in range(300)],
        "random": [(draw.randrange(400), draw.randrange(400)) for _ in range(300)],
        "star": [(500, i) for i in range(200)] + [(i, i + 1000) for i in range(0, 200, 2)],
    }[shape]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    apart = {n for a, b in edges if a != b for n in (a, b)}
    labels = near_duplicates.components(spark.createDataFrame(edges, "low long, high long"))
    assert {r["node"]: r["label"] for r in labels.collect()} == {n: root(n) for n in apart}


def test_jobs_stay_few(spark):
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("near", "near")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    deduplicated(docs).count()
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("near")) <= 100


def test_short_texts_have_one_shingle():
    block = next(grams.blocks(pa.array(["a b", "a b c d e f"]), grams.LETTERS))
    owner, _, repeats, weights = near_duplicates.shingle_weights(
        block, near_duplicates.Rarity(np.zeros(0, np.uint64), np.zeros(0), 2.0), 5
    )
    assert owner.tolist() == [0, 1, 1] and repeats.tolist() == [1, 1, 1] and weights.tolist() == [2, 2, 2]

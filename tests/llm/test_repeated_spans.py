import hashlib
import random

import numpy as np
import pytest

from cohortry.llm import repeated_spans
from cohortry.llm.repeated_spans import cut_documents, digest, sliding_minimum
from tests.llm.edges import WORDS, awkward, documents, nothing
from tests.llm.test_grams import thue_morse


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def brute(rows, span=13):
    first = {}
    for i, t in rows:
        ws = words_of(t)
        for at in range(len(ws) - span + 1):
            key = tuple(ws[at : at + span])
            first[key] = min(first.get(key, i), i)
    found = {}
    for i, t in rows:
        ws = words_of(t)
        gone = set()
        for at in range(len(ws) - span + 1):
            if first[tuple(ws[at : at + span])] < i:
                gone.update(range(at, at + span))
        kept = " ".join(w for at, w in enumerate(ws) if at not in gone)
        found[i] = (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return found


def judged(docs):
    rows = digest(cut_documents(docs)).collect()
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows}


def overlapping(seed, count=60):
    """Documents made of shared passages, cut anywhere, and of repeated words."""
    draw = random.Random(seed)
    passages = [draw.choices(WORDS, k=draw.randint(10, 80)) for _ in range(8)]
    passages += [["same"] * 90, ["x", "y"] * 40]
    rows = []
    for i in range(count):
        words = []
        for _ in range(draw.randint(0, 5)):
            passage = draw.choice(passages)
            at = draw.randrange(len(passage))
            words += passage[at : at + draw.randint(5, 80)] + draw.choices(WORDS, k=draw.randint(0, 5))
        rows.append((i, draw.choice([" ", "  ", "\n"]).join(words), "s"))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = overlapping(seed)
    assert judged(documents(spark, rows)) == brute([(i, t) for i, t, _ in rows])


def test_frequent_grams_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(repeated_spans, "LOOKED_AT", 1)
    monkeypatch.setattr(repeated_spans, "FREQUENT_AT_LEAST", 4)
    rows = overlapping(9)
    docs = documents(spark, rows)
    assert len(repeated_spans.frequent_grams(docs, 13, 5)) > 0
    assert judged(docs) == brute([(i, t) for i, t, _ in rows])


def test_wrong_matches_do_not_survive_the_source(spark, monkeypatch):
    """With edge hashes that all collide, only truly equal edges are removed."""
    monkeypatch.setattr(repeated_spans, "_low_half", lambda h: (h & np.uint64(0x7)).astype(np.int32))
    rows = [(i, " ".join(WORDS[i * 20 : i * 20 + 40]), "s") for i in range(3)]
    found = judged(documents(spark, rows))
    assert all(n_removed <= 20 for _, n_removed, _ in found.values())


def test_edges_alike_in_their_low_half_keep_their_own_sources(spark, monkeypatch):
    runs = repeated_spans.grams.runs

    def high_half(hashes, length, seed=0):
        found = runs(hashes, length, seed)
        return found << np.uint64(32) if seed == repeated_spans.EDGE_SEED else found

    monkeypatch.setattr(repeated_spans.grams, "runs", high_half)
    rows = overlapping(4)
    assert judged(documents(spark, rows)) == brute([(i, t) for i, t, _ in rows])


def test_awkward_rows(spark):
    found = judged(awkward(spark))
    empty = hashlib.sha256(b"").hexdigest()
    assert found[1][:2] == (60, 0) and found[2] == (60, 60, empty)
    assert found[3] == found[4] == found[5] == (0, 0, empty)
    assert found[6][:2] == (16_000, 2_400) and found[7][:2] == (1, 0)
    assert found[10][:2] == (500, 0) and found[None][:2] == (60, 0)
    assert digest(cut_documents(nothing(spark))).count() == 0


def test_one_doc_id_with_two_texts(spark):
    a, b = " ".join(WORDS[:30]), " ".join(WORDS[50:80])
    docs = documents(spark, [(1, a, "s"), (2, b, "s"), (2, a, "s"), (3, b, "s")])
    rows = sorted((r["doc_id"], r["n_removed"]) for r in cut_documents(docs).collect())
    assert rows == [(1, 0), (2, 0), (2, 30), (3, 30)]


def test_words_that_only_a_better_hash_tells_apart(spark):
    left, right = thue_morse(2048)
    rows = [(1, " ".join([left] + WORDS[:12]), "s"), (2, " ".join([right] + WORDS[:12]), "s")]
    rows.append((3, " ".join([left] + WORDS[:12]), "s"))
    assert judged(documents(spark, rows)) == brute([(i, t) for i, t, _ in rows])


def test_bits_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(repeated_spans, "small_enough", lambda df: df)
    rows = overlapping(6)
    assert judged(documents(spark, rows)) == brute([(i, t) for i, t, _ in rows])


def test_only_rows_that_documents_share_are_marked(spark):
    rows = [(1, " ".join(WORDS[:60]), "s"), (2, " ".join(WORDS[40:100]), "s"), (3, " ".join(WORDS[200:260]), "s")]
    nothing_frequent = spark.sparkContext.broadcast(np.zeros(0, np.int64))
    docs = documents(spark, rows)
    bits = {r["_id"]: bytes(r["bits"]) for r in repeated_spans.shared_rows(docs, nothing_frequent, 13, 5).collect()}
    assert set(bits) == {1, 2} and all(0 < sum(b.bit_count() for b in held) < 12 for held in bits.values())


@pytest.mark.parametrize("by_shuffle", [False, True])
def test_a_source_with_many_requests_is_read_in_parts(spark, monkeypatch, by_shuffle):
    monkeypatch.setattr(repeated_spans, "REQUESTS_TOGETHER", 3)
    if by_shuffle:
        monkeypatch.setattr(repeated_spans, "small_enough", lambda df: df)
    passage, other = " ".join(WORDS[:40]), " ".join(WORDS[50:70])
    rows = [(0, passage, "s")] + [(n, f"a{n} {passage} b{n}", "s") for n in range(1, 30)]
    rows += [(100, other, "s"), (101, f"x {other}", "s")]
    assert judged(documents(spark, rows)) == brute([(i, t) for i, t, _ in rows])


def test_sliding_minimum():
    draw = np.random.default_rng(1)
    values = draw.integers(0, 50, 200).astype(np.uint64)
    for width in (1, 2, 5, 8, 9, 13):
        expected = [values[i : i + width].min() for i in range(len(values) - width + 1)]
        assert sliding_minimum(values, width).tolist() == expected

"""Fill-in-the-middle against plain Python, and exact round trips."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortry.llm import fill_in_middle
from cohortry.llm.fill_in_middle import Plan
from tests.llm.edges import awkward, documents, nothing


def drawn(doc_id, seed=1):
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def brute(doc_id, text):
    text = text or ""
    h, n = drawn(doc_id), len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def random_texts(count, seed=1):
    rng = random.Random(seed)
    letters = "ab é日😀\n<P>SM"
    return ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 40, 300]))) for _ in range(count)]


@pytest.mark.parametrize("together", [1, 7, 1 << 17])
def test_batches_match_brute_force(together, monkeypatch):
    monkeypatch.setattr(fill_in_middle.pieces, "__defaults__", (together,))
    texts = [*random_texts(400 if together > 1 else 40), None]
    numbers = np.array([drawn(i) for i in range(len(texts))])
    found = fill_in_middle.arranged(pa.array(texts, pa.string()), list(numbers.T), Plan())
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    assert [tuple(r[n] for n in names) for r in found.to_pylist()] == [brute(i, t) for i, t in enumerate(texts)]


def test_rows_and_round_trip(spark):
    more = documents(spark, [(100 + i, t, "x") for i, t in enumerate(random_texts(300, 2))])
    docs = awkward(spark).unionByName(more)
    found = fill_in_middle.transformed(docs)
    again = found.withColumn("text", fill_in_middle.restored(F.col("output"), F.col("form")))
    rows = again.collect()
    got = sorted(
        [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["text"]) for r in rows],
        key=str,
    )
    wanted = sorted(
        [(r["doc_id"], *brute(r["doc_id"], r["text"]), r["text"] or "") for r in docs.collect()], key=str
    )
    assert got == wanted
    assert {"plain", "psm", "spm"} == {r["form"] for r in rows}


def test_pieces_that_look_like_the_start_of_a_mark(spark):
    texts = ["<<P", "a<", "<P<S", "<M", "<S<P<M", "<<<<<<<<", "P>S>M>"]
    docs = documents(spark, [(i, texts[i % len(texts)], "a") for i in range(200)])
    found = fill_in_middle.transformed(docs)
    again = found.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form")).alias("text"))
    assert {r["doc_id"]: r["text"] for r in again.collect()} == {i: texts[i % len(texts)] for i in range(200)}


@pytest.mark.parametrize(
    "unit, units", [("words", ["a  ", "b\n", "c ", "é\n\n ", "x"]), ("lines", ["a  b\n", "c é\n", "\n", " x"])]
)
def test_other_units(spark, unit, units):
    counts, found = fill_in_middle.unit_lists(pa.array(["", "a  b\nc é\n\n x", None]), unit)
    assert counts.tolist() == [0, len(units), 0] and found.to_pylist() == units
    plan = Plan(unit=unit, changed=100)
    docs = documents(spark, [(i, "a  b\nc é\n\n x", "a") for i in range(40)])
    rows = fill_in_middle.transformed(docs, plan).withColumn(
        "text", fill_in_middle.restored(F.col("output"), F.col("form"), plan)
    )
    edges = {sum(len(u) for u in units[:i]) for i in range(len(units) + 1)}
    for r in rows.collect():
        assert r["n"] == len(units) and r["text"] == "a  b\nc é\n\n x"
        assert {r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]} <= edges


def test_marks_are_checked():
    for wrong in ({"prefix": "<S>"}, {"middle": "<<"}, {"suffix": "S"}, {"prefix": "[P]"}, {"unit": "bytes"}):
        with pytest.raises(ValueError):
            Plan(**wrong)


def test_empty_table(spark):
    assert fill_in_middle.digest(fill_in_middle.transformed(nothing(spark))).count() == 0


def test_very_long_text(spark):
    text = "long é " * 150_000
    found = fill_in_middle.digest(fill_in_middle.transformed(documents(spark, [(1, text, "a")]))).first()
    n, form, prefix, middle, output = brute(1, text)
    assert (found["n"], found["form"], found["prefix_chars"], found["middle_chars"]) == (n, form, prefix, middle)
    assert found["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
    assert found["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()

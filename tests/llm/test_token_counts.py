"""Token counts against the libraries on whole texts."""

import random

import numpy as np
import pytest
import sentencepiece
import tokenizers

from cohortry.llm import token_counts, vocabularies
from cohortry.llm.vocabularies import file_of, vocabulary
from tests.conftest import SMALL
from tests.llm.edges import awkward, documents, nothing

PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"


def library(name):
    """Whole texts by the library itself."""
    if name == PIECES:
        processor = sentencepiece.SentencePieceProcessor(model_file=file_of(name))
        return lambda text: len(processor.encode(text or ""))
    tokenizer = tokenizers.Tokenizer.from_file(file_of(name))
    tokenizer.encode_special_tokens = True
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def texts():
    rng = random.Random(4)
    letters = "ab  \n\t éß日本😀'<s>|▁1.\x1c "
    mixed = ["".join(rng.choice(letters) for _ in range(n)) for n in (1, 5, 90, 400, 3000, 3001)]
    runs = ["a" * 2500, " " * 2000, "\n" * 1500, "the " * 900, "日本" * 700, "\u0001" * 600, "thethe" * 400]
    return [*mixed, *runs, "<s></s><unk><|endoftext|>", None, ""]


@pytest.mark.parametrize("name", [PIECES, BYTES])
@pytest.mark.parametrize("step, overlap", [(64, 2), (100, 16), (300, 300)])
def test_chunks_count_like_the_library(spark, name, step, overlap):
    given = texts()
    docs = documents(spark, [(i, t, "a") for i, t in enumerate(given)])
    found = token_counts.counted(docs, vocabulary(file_of(name)), ["doc_id"], huge=80, step=step, overlap=overlap)
    count = library(name)
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in found.collect()} == {
        i: (len((t or "").encode()), count(t)) for i, t in enumerate(given)
    }


def test_overlaps_without_stable_place_are_widened(spark, monkeypatch):
    asked = []
    plain = token_counts.reports
    monkeypatch.setattr(token_counts, "reports", lambda s, v, step, o: asked.append(o) or plain(s, v, step, o))
    text = "x " * 100 + "a" * 900 + " y" * 100
    docs = documents(spark, [(1, text, "a"), (2, "b " * 500, "a")])
    found = token_counts.counted(docs, vocabulary(file_of(PIECES)), ["doc_id"], huge=100, step=100, overlap=20)
    assert found.orderBy("doc_id").first()["n_tokens"] == library(PIECES)(text)
    assert len(asked) > 1


@pytest.mark.parametrize("name", [PIECES, BYTES])
def test_stable_places_hold_in_any_surroundings(name):
    """No token of a random text spans a place that is called stable."""
    held, rng = vocabulary(file_of(name)), random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice("ab the ing\n\t  é日.'s1\x1c") for _ in range(60))
        (ids,) = held.encode([text])
        ends = set((np.cumsum(held.characters[ids]) - held.prefix).tolist())
        stable = np.flatnonzero(held.stable(vocabularies.codes_of(text))) + 1
        assert set(stable.tolist()) <= ends


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = token_counts.counted(docs, vocabulary(file_of(PIECES)), ["doc_id"], huge=2000, step=1000, overlap=64)
    count = library(PIECES)
    wanted = {r["doc_id"]: count(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in found.collect()} == wanted


def test_awkward_documents(spark):
    docs = awkward(spark)
    found = token_counts.counted(docs, vocabulary(file_of(PIECES)), ["doc_id"], huge=500, step=400, overlap=50)
    count = library(PIECES)
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in found.collect()), key=str)
    assert got == sorted(((r["doc_id"], count(r["text"])) for r in docs.collect()), key=str)
    assert token_counts.counted(nothing(spark), vocabulary(file_of(PIECES)), ["doc_id"]).count() == 0


def test_keys_may_have_any_name(spark):
    docs = documents(spark, [(1, "a b " * 300, "a")]).withColumnsRenamed({"doc_id": "tokens", "source": "row"})
    found = token_counts.counted(docs, vocabulary(file_of(PIECES)), ["tokens", "row"], huge=10, step=50, overlap=9)
    row = found.first()
    assert (row["tokens"], row["row"], row["n_tokens"]) == (1, "a", library(PIECES)("a b " * 300))


def test_unknown_vocabularies_are_refused():
    with pytest.raises(ValueError):
        vocabulary(file_of("word_bpe_49k.json")).encode(["a"])
    with pytest.raises(ValueError):
        token_counts.counted(None, None, [], step=5, overlap=9)

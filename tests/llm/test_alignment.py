"""Alignment against plain Python on whole texts, one token at a time."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
import tokenizers

from cohortry.llm import alignment
from cohortry.llm.vocabularies import byte_alphabet, file_of, vocabulary
from tests.conftest import SMALL
from tests.llm.edges import awkward, documents, nothing

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def libraries():
    tokenizer = tokenizers.Tokenizer.from_file(file_of(A))
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=file_of(B))


def piece_bytes(processor, i):
    piece = processor.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace("▁", " ").encode()


def tokens(libraries, text):
    """(id, begin, end) in bytes for both, or nothing."""
    tokenizer, processor = libraries
    if not text:
        return [], []
    whole, alphabet = f" {text}".encode(), byte_alphabet()
    a = [
        (i, bytes(alphabet[c] for c in tokenizer.id_to_token(i)))
        for i in tokenizer.encode(f" {text}", add_special_tokens=False).ids
    ]
    b = [(i, piece_bytes(processor, i)) for i in processor.encode(text)]
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return [], []

    def placed(items):
        at = 0
        for i, held in items:
            yield i, at, at + len(held)
            at += len(held)

    return list(placed(a)), list(placed(b))


def brute(libraries, rows):
    """The contract's columns of each (doc_id, text)."""
    each, counts = [], Counter()
    for doc_id, text in rows:
        a, b = tokens(libraries, text)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [
            ([i for i, _, e in a if low < e <= high], [i for i, _, e in b if low < e <= high])
            for low, high in zip([0, *cuts], cuts, strict=False)
        ]
        links = []
        for i, low, high in a:
            links += [(i, j) for j, begin, end in b if begin < high and end > low]
        counts.update(links)
        each.append((doc_id, a, b, groups, links))
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    found = []
    for doc_id, a, b, groups, links in each:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append(
            (
                doc_id, len(a), len(b), len(groups), len(links),
                sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
                hashlib.sha256(text.encode()).hexdigest() if groups else "",
            )
        )
    return sorted(found, key=str), counts


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(found):
    return sorted([tuple(r[c] for c in COLUMNS) for r in found.collect()], key=str)


def texts():
    rng = random.Random(5)
    letters = "ab the ing\n\t  éß日本😀'<s>|1.,"
    mixed = ["".join(rng.choice(letters) for _ in range(n)) for n in (1, 2, 5, 30, 90, 200, 400)]
    odd = ["a▁b", "▁", " ", "  ", "\n", "<|endoftext|>", "<s>", "</s><unk>", "é", "<0x41>", "aaaa" * 20, "ﬁ  x"]
    return [*mixed, *odd, "the cat sat on the mat " * 12, None, "", "﻿", "\u0001\u0002"]


@pytest.mark.parametrize("most_bytes", [0, alignment.MOST_BROADCAST_BYTES])
@pytest.mark.parametrize("part", [10, 1 << 15])
def test_matches_brute_force(spark, libraries, monkeypatch, most_bytes, part):
    monkeypatch.setattr(alignment.parts_of, "__defaults__", (part,))
    given = [(i, t) for i, t in enumerate(texts())] + [(3, texts()[3]), (None, "the end"), (None, None)]
    docs = documents(spark, [(i, t, "a") for i, t in given])
    found, counts = alignment.links(docs, vocabulary(file_of(A)), vocabulary(file_of(B)), most_bytes)
    wanted, pairs = brute(libraries, given)
    assert rows_of(found) == wanted
    assert {(r["a"], r["b"]): r["links"] for r in counts.collect()} == dict(pairs)


def test_given_documents(spark, libraries):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 1500]
    short = docs.where("length(coalesce(text, '')) < 1500")
    found, _ = alignment.links(short, vocabulary(file_of(A)), vocabulary(file_of(B)))
    assert rows_of(found) == brute(libraries, rows)[0]


def test_identity_map_names_equal_bytes():
    a, b = vocabulary(file_of(A)), vocabulary(file_of(B))
    same = alignment.identity_map(a, b)
    assert (same >= 0).sum() > 10_000
    assert all(a.token_bytes[i] == b.token_bytes[j] for i, j in enumerate(same) if j >= 0)


def test_units_tokenize_like_the_whole(libraries):
    tokenizer, processor = libraries
    rng = random.Random(6)
    for _ in range(100):
        text = "".join(rng.choice("ab the 's \n\t  é日.▁\x1c") for _ in range(300))
        units = [u for p in alignment.parts_of(text, 20) for u in alignment._CUT.split(p)]
        assert " ".join(units) == text and len(units) > 1
        by_units = [i for u in units for i in tokenizer.encode(f" {u}", add_special_tokens=False).ids]
        assert by_units == tokenizer.encode(f" {text}", add_special_tokens=False).ids
        assert [i for u in units for i in processor.encode(u)] == processor.encode(text)


def test_units_are_forgotten_beyond_a_bound(monkeypatch):
    aligner = alignment.Aligner(vocabulary(file_of(A)), vocabulary(file_of(B)))
    given = pa.array(texts(), pa.string())
    wanted = aligner.rows(given)
    monkeypatch.setattr(alignment, "MOST_UNITS", 0)
    for _ in range(2):
        assert aligner.rows(given) == wanted


def test_awkward_documents(spark, libraries):
    docs = awkward(spark).where("doc_id is null or doc_id not in (6, 10)")
    found, _ = alignment.links(docs, vocabulary(file_of(A)), vocabulary(file_of(B)))
    assert rows_of(found) == brute(libraries, [(r["doc_id"], r["text"]) for r in docs.collect()])[0]
    assert alignment.links(awkward(spark), vocabulary(file_of(A)), vocabulary(file_of(B)))[0].count() == 11
    empty, counts = alignment.links(nothing(spark), vocabulary(file_of(A)), vocabulary(file_of(B)))
    assert empty.count() == 0 and counts.count() == 0


def test_very_long_text_without_spaces(spark, libraries):
    text = "abcdefgh" * 12_000
    docs = documents(spark, [(1, text, "a")])
    found, _ = alignment.links(docs, vocabulary(file_of(A)), vocabulary(file_of(B)))
    row = found.first()
    a, b = tokens(libraries, text)
    assert (row["n_a"], row["n_b"]) == (len(a), len(b))

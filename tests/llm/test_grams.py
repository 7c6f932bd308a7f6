import re

import numpy as np
import pyarrow as pa

from cohortry.llm import grams

TEXTS = ["a b  c", None, "", "  x\ty\n", "ab", "é à b", "b", "x" * 10 + " a", "A a_b", "a b", "日本 語", "a" * 5000]


def check(classes, words_of):
    seen = {}
    for most in (1, 4, 64, 1 << 17):
        rows = []
        for block in grams.blocks(pa.array(TEXTS, pa.string()), classes, most):
            for i in range(len(block)):
                words = words_of(TEXTS[block.first + i] or "")
                at = block.words(i)
                spelled = [
                    block.data[b:e].tobytes().decode() for b, e in zip(block.begins[at], block.ends[at], strict=True)
                ]
                rows.append(block.first + i)
                assert len(words) == len(spelled) == len(block.hashes[at])
                for word, number in zip(words, block.hashes[at].tolist(), strict=True):
                    assert seen.setdefault(word, number) == number
        assert rows == list(range(len(TEXTS)))
    assert len(set(seen.values())) == len(seen)


def test_words_between_white_space():
    check(grams.SPACED, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t))


def test_words_of_letters_and_digits():
    fold = {i: i + 32 for i in range(65, 91)}
    check(grams.LETTERS, lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(fold)))


def test_runs_tell_orders_and_lengths_apart():
    words = np.arange(1, 9, dtype=np.uint64)
    assert len(grams.runs(words, 9)) == 0
    assert len(set(grams.runs(words, 3).tolist()) | set(grams.runs(words[::-1], 3).tolist())) == 12
    assert grams.runs(words, 8, 1)[0] != grams.runs(words, 8, 2)[0]


def test_a_slice_of_a_batch():
    whole = pa.array(TEXTS, pa.string())
    all_words = [h for b in grams.blocks(whole, grams.SPACED) for i in range(len(b)) for h in b.hashes[b.words(i)]]
    parts = [whole.slice(0, 5), whole.slice(5)]
    by_part = [
        h for p in parts for b in grams.blocks(p, grams.SPACED) for i in range(len(b)) for h in b.hashes[b.words(i)]
    ]
    assert all_words == by_part


def thue_morse(length):
    """Two words that polynomials modulo a power of two cannot tell apart."""
    ones = [bin(i).count("1") % 2 for i in range(length)]
    return "".join("ab"[b] for b in ones), "".join("ba"[b] for b in ones)


def test_regular_words_are_told_apart():
    left, right = thue_morse(4096)
    (block,) = grams.blocks(pa.array([f"{left} {right} {left}"]), grams.SPACED)
    assert block.hashes[0] == block.hashes[2] != block.hashes[1]


def test_seeds_give_independent_hashes():
    first, second = (next(grams.blocks(pa.array(["a b c a"]), grams.SPACED, seed=s)).hashes for s in (0, 1))
    assert not set(first.tolist()) & set(second.tolist()) and second[0] == second[3]

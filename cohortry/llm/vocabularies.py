"""Public tokenizers as Spark tasks need them: ids, bytes of each id, safe places to cut.

The driver reads a vocabulary file and broadcasts its bytes, a few megabytes whatever
the corpus, so executors need no file. Two kinds are known: piece models (BPE
with byte fallback, no normalisation) and byte-level BPE files split by a pattern.

A place between two characters is stable if no token can ever span it, whatever
stands around. For a piece model, merges only make pieces of the vocabulary, so
a place is stable if no piece holds its two characters side by side. The pattern
of the byte-level files never matches white space behind another character, and
looks ahead only from white space, so it is stable there.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

import numpy as np

SPACE_MARK = "▁"
_CODE_BITS = 21

# Characters with the Unicode property White_Space.
WHITE_SPACE = [
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]


def file_of(name: str) -> str:
    """The place of one of the public vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary(path: str) -> Pieces | ByteLevel:
    raw = Path(path).read_bytes()
    return Pieces(raw) if path.endswith(".model") else ByteLevel(raw)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable characters of Latin-1 stand for themselves; the other bytes take
    the characters from 256 on, in order.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Vocabulary:
    raw: bytes = field(repr=False)

    def __getstate__(self) -> dict:
        # Loaded tokenizers stay where they were loaded.
        return {"raw": self.raw}

    def __setstate__(self, state: dict) -> None:
        self.raw = state["raw"]

    @cached_property
    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after another, and where each begins."""
        lengths = [len(b) for b in self.token_bytes]
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        return np.frombuffer(b"".join(self.token_bytes), np.uint8), starts

    @cached_property
    def lengths(self) -> np.ndarray:
        """Bytes of each id."""
        return np.diff(self.joined[1])

    @cached_property
    def characters(self) -> np.ndarray:
        """How many characters begin within each id."""
        data, starts = self.joined
        before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return before[starts[1:]] - before[starts[:-1]]

    @cached_property
    def inside(self) -> np.ndarray:
        """Which ids begin in the middle of a character."""
        return np.array([b[:1] >= b"\x80" and b[:1] < b"\xc0" for b in self.token_bytes])

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        data, starts = self.joined
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shift = starts[ids] - (ends - lengths)
        return data[np.repeat(shift, lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Pieces(Vocabulary):
    """A piece model. It puts a space before the text, and writes spaces as U+2581."""

    # Characters that the tokenizer puts before a text.
    prefix = 1

    @cached_property
    def processor(self):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=self.raw)
        marked = SPACE_MARK
        if processor.normalize(" a  ﬁ ") != f"{marked * 2}a{marked * 2}ﬁ{marked}":
            raise ValueError("the model normalises texts, so places in it are not places of the text")
        return processor

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)

    @cached_property
    def token_bytes(self) -> list[bytes]:
        processor, found = self.processor, []
        for i in range(processor.vocab_size()):
            piece = processor.id_to_piece(i)
            found.append(
                bytes([int(piece[3:5], 16)])
                if processor.is_byte(i)
                else piece.replace(SPACE_MARK, " ").encode()
            )
        return found

    @cached_property
    def is_byte(self) -> np.ndarray:
        return np.array([self.processor.is_byte(i) for i in range(self.processor.vocab_size())])

    @cached_property
    def joint_pairs(self) -> np.ndarray:
        """Pairs of neighbouring characters that some piece holds, as sorted numbers."""
        processor, pairs = self.processor, set()
        for i in range(processor.vocab_size()):
            if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i)):
                piece = processor.id_to_piece(i)
                pairs.update(zip(piece, piece[1:], strict=False))
        return np.sort(np.array([(ord(x) << _CODE_BITS) | ord(y) for x, y in pairs], np.int64))

    def stable(self, codes: np.ndarray) -> np.ndarray:
        """For each place between two characters whether no token can span it."""
        codes = np.where(codes == 32, ord(SPACE_MARK), codes).astype(np.int64)
        pairs = (codes[:-1] << _CODE_BITS) | codes[1:]
        known = self.joint_pairs
        at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
        return known[at] != pairs


class ByteLevel(Vocabulary):
    """A byte-level file. Special tokens in a text are ordinary text."""

    prefix = 0

    @cached_property
    def tokenizer(self):
        # The tasks are parallel already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        given = json.loads(self.raw)
        split = given.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if given.get("normalizer") or not plain:
            raise ValueError("only byte-level vocabularies with their own pattern and no normaliser are known")
        tokenizer = tokenizers.Tokenizer.from_str(self.raw.decode())
        tokenizer.encode_special_tokens = True
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @cached_property
    def token_bytes(self) -> list[bytes]:
        alphabet = byte_alphabet()
        given = self.tokenizer.get_vocab()
        found = [b""] * (max(given.values()) + 1)
        for token, i in given.items():
            known = all(c in alphabet for c in token)
            found[i] = bytes(alphabet[c] for c in token) if known else token.encode()
        return found

    def stable(self, codes: np.ndarray) -> np.ndarray:
        # Separators that only some pattern engines call white space are taken as neither.
        unsure = (codes >= 0x1C) & (codes <= 0x1F)
        space = np.isin(codes, WHITE_SPACE)
        return ~(space | unsure)[:-1] & space[1:]


def codes_of(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)

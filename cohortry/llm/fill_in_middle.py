"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and put in another order.

A text is cut into units: code points, words (each with the white space behind it) or
lines. Two hash-seeded draws from 0 to n give the units at which the prefix and the
middle end. Most texts are then written as prefix, suffix, middle (``psm``), some
as suffix, prefix, middle (``spm``), each piece behind its mark; the others,
and texts that are empty or hold a mark, stay as they are (``plain``).

The work is a pipeline of pyarrow.compute on whole batches: units become list
arrays, which are flattened with the indices of their parents; ordinals within the
parent give each unit its role; the units of a role are filtered, made lists again and
joined. Long texts are cut into parts of bounded size, whose pieces are joined at the end,
so memory follows the batch, not the number of its units.

A null text counts as empty. A null doc_id draws as the empty string. Repeated rows give
the same result each. An empty table gives an empty result. Only doc_id and text are
read, so columns of other names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 1
UNITS = ("characters", "words", "lines")
# Units that are flattened together.
TOGETHER = 1 << 17

PREFIX, MIDDLE, SUFFIX = 0, 1, 2


@dataclass(frozen=True)
class Plan:
    """Marks of the pieces, shares in percent, seed and unit of the cuts."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    changed: int = 90
    suffix_first: int = 20
    seed: int = SEED
    unit: str = "characters"

    def __post_init__(self) -> None:
        if self.unit not in UNITS:
            raise ValueError(f"unit is one of {', '.join(UNITS)}")
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or any(len(m) < 2 or m[0] in m[1:] for m in marks):
            # Then no mark can begin within another one or at the end of a piece.
            raise ValueError("marks must differ, and hold their first character once")
        if len({m[0] for m in marks}) > 1:
            raise ValueError("marks must begin with the same character")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the first groups of SHA-256 of ``seed:doc_id``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    hexadecimal = F.sha2(name, 256)
    return [F.conv(F.substring(hexadecimal, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def unit_starts(data: np.ndarray, offsets: np.ndarray, unit: str) -> np.ndarray:
    """The bytes at which a unit begins; a text that is not empty begins one."""
    if unit == "characters":
        return np.flatnonzero((data & 0xC0) != 0x80)
    before = np.empty_like(data)
    before[:1] = 0
    before[1:] = data[:-1]
    if unit == "lines":
        new = before == 10
    else:
        spaces = np.zeros(256, bool)
        spaces[[32, *range(9, 14)]] = True
        new = ~spaces[data] & spaces[before]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    new[filled] = True
    return np.flatnonzero(new)


def unit_lists(texts: pa.Array, unit: str) -> tuple[np.ndarray, pa.Array]:
    """The number of units of each text, and all units of all texts one after another."""
    whole = pc.fill_null(texts, "").cast(pa.large_string())
    buffers = whole.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[: offsets[-1]] if buffers[2] else np.zeros(0, np.uint8)
    data, offsets = data[offsets[0] :], offsets - offsets[0]
    starts = unit_starts(data, offsets, unit)
    bounds = np.append(starts, len(data)).astype(np.int64)
    units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data))
    return np.diff(np.searchsorted(starts, offsets)), units


def pieces(
    counts: np.ndarray, units: pa.Array, first: np.ndarray, second: np.ndarray, together: int = TOGETHER
) -> list[pa.Array]:
    """Prefix, middle and suffix of every text: units up to ``first``, up to ``second``, the rest."""
    begins = np.concatenate([[0], np.cumsum(counts)])
    # Parts: stretches of units of one text, a bounded number of units together.
    found: list[list[pa.Array]] = [[], [], []]
    owners = []
    for low in range(0, max(int(begins[-1]), 1), together):
        high = min(low + together, int(begins[-1]))
        texts = np.arange(
            np.searchsorted(begins, low, "right") - 1, max(np.searchsorted(begins, high, "left"), 1)
        )
        texts = texts[texts < len(counts)]
        edges = np.clip(begins[np.append(texts, texts[-1] + 1 if len(texts) else 0)], low, high)
        lists = pa.LargeListArray.from_arrays(pa.array(edges - low), units.slice(low, high - low))
        flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
        # The place of a unit in its text: its place here less that of the text's first unit.
        ordinals = pc.subtract(pa.array(np.arange(low, high)), pc.take(pa.array(begins[texts]), parents))
        is_prefix = pc.less(ordinals, pc.take(pa.array(first[texts]), parents))
        is_suffix = pc.greater_equal(ordinals, pc.take(pa.array(second[texts]), parents))
        roles = {PREFIX: is_prefix, MIDDLE: pc.invert(pc.or_(is_prefix, is_suffix)), SUFFIX: is_suffix}
        for role, mask in roles.items():
            kept = pc.filter(parents, mask).to_numpy()
            sizes = np.bincount(kept, minlength=len(texts))
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]))
            again = pa.LargeListArray.from_arrays(ends, pc.filter(flat, mask))
            found[role].append(pc.binary_join(again, pa.scalar("", pa.large_string())))
        owners.append(texts)
    return [_joined(parts, np.concatenate(owners), len(counts)) for parts in found]


def _joined(parts: list[pa.Array], owners: np.ndarray, count: int) -> pa.Array:
    """The parts of each text joined in order; a text without parts is empty."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=count))])
    lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.concat_arrays(parts))
    return pc.binary_join(lists, pa.scalar("", pa.large_string()))


def arranged(texts: pa.Array, drawn: list[np.ndarray], plan: Plan) -> pa.RecordBatch:
    """n, form, output, prefix_chars and middle_chars of a batch of texts."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    counts, units = unit_lists(texts, plan.unit)
    ends = [drawn[0] % (counts + 1), drawn[1] % (counts + 1)]
    first, second = np.minimum(*ends), np.maximum(*ends)
    prefix, middle, suffix = pieces(counts, units, first, second)
    marked = pc.equal(pc.binary_length(texts), 0)
    for mark in plan.marks:
        marked = pc.or_(marked, pc.match_substring(texts, mark))
    plain = pc.or_(marked, pa.array(drawn[2] % 100 >= plan.changed))
    spm = pa.array(drawn[3] % 100 < plan.suffix_first)
    p, s, m = (pa.scalar(mark, pa.large_string()) for mark in plan.marks)
    nothing = pa.scalar("", pa.large_string())
    output = pc.if_else(
        plain,
        texts,
        pc.if_else(
            spm,
            pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, nothing),
            pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, nothing),
        ),
    )
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    none = pa.scalar(None, pa.int64())
    return pa.record_batch(
        {
            "n": pa.array(counts, pa.int64()),
            "form": form.cast(pa.string()),
            "prefix_chars": pc.if_else(plain, none, pc.utf8_length(prefix).cast(pa.int64())),
            "middle_chars": pc.if_else(plain, none, pc.utf8_length(middle).cast(pa.int64())),
            "output": output.cast(pa.string()),
        }
    )


def transformed(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every row."""
    plan = plan or Plan()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [batch.column(f"h{i}").to_numpy() for i in range(1, 5)]
            done = arranged(batch.column("text"), drawn, plan)
            yield pa.record_batch([batch.column("doc_id"), *done.columns], ["doc_id", *done.schema.names])

    hashes = [h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), plan.seed), 1)]
    return docs.select("doc_id", "text", *hashes).mapInArrow(
        arrange,
        f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string",
    )


def restored(output: Column, form: Column, plan: Plan | None = None) -> Column:
    """The text that an output was made from."""
    plan = plan or Plan()
    # No piece holds a mark, so the marks in the output are those that were set.
    body = F.substring(output, len(plan.prefix) + 1, 2_147_483_647)
    spm_body = F.substring(output, len(plan.suffix) + 1, 2_147_483_647)
    inner = [f"\\Q{plan.suffix}\\E|\\Q{plan.middle}\\E", f"\\Q{plan.prefix}\\E|\\Q{plan.middle}\\E"]
    psm, spm = F.split(body, inner[0], -1), F.split(spm_body, inner[1], -1)
    return (
        F.when(form == "psm", F.concat(psm[0], psm[2], psm[1]))
        .when(form == "spm", F.concat(spm[1], spm[2], spm[0]))
        .otherwise(output)
    )


def digest(rows: DataFrame, plan: Plan | None = None) -> DataFrame:
    """The outputs, and the texts rebuilt from them, as their SHA-256."""
    text = restored(F.col("output"), F.col("form"), plan)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(text, 256).alias("restored_sha256"),
    )

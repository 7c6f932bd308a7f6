"""Personal data by base patterns and bootstrapped contextual patterns.

Base spans, leftmost and non-overlapping per kind, in code points:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip, four dotted numbers of at most 255
* card ``[0-9]([\\x20-]?[0-9])+`` with 16 to 19 digits that pass the Luhn check
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]`` with 8 to 15 digits

Base spans are the seeds. The value of a span is an instance, and the text in front of it
makes up to three patterns: the two words in front on the line, without their
punctuation and with digits made equal; the word in front, if it is a label (it ends with
``:``, ``=`` or ``#``), which may begin the line; and that label with the shape of the value.
Words that look like identifiers (digits or an at sign, outside base spans) and groups of
digits with the separators of the base patterns are candidate instances.

The graph of patterns and instances is scored per kind in rounds: a pattern is as reliable as
the lower confidence bound of the share of its distinct instances that are of the kind, which
takes several instances, nearly all of them right; a candidate is as likely as at least one
of its reliable patterns being right. Rounds end when no candidate is accepted that
was not before. Accepted candidates add spans of their kind; base spans stay.

A null or empty text has no spans. Rows that repeat doc_id and text repeat their
result; different texts under one doc_id are told apart. Empty tables give empty
results. Only doc_id and text are read, so columns of other names do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import apart, cut, small_enough, text_key

KINDS = ("email", "ip", "card", "phone")
# A pattern counts if so many distinct scored instances follow it.
SUPPORT = 3.0
RELIABLE = 0.6
ACCEPTED = 0.6
# Standard errors below the observed share that a pattern's reliability is put.
CAUTION = 1.28
SHORTEST_CANDIDATE = 6
FEWEST_GROUPED_DIGITS = 7


LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# Matches of these begin at the start of a run of digits; what the lookbehind
# rules out could only repeat the scan of one run from each of its digits.
ADDRESS = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
MARK = re.compile(r"[0-9]+|@")
EDGES = "\"'`()[]{}<>.,;:!?|*#$%&="
# What may stand between a label and its value.
EDGES_BEFORE = " \t\"'`([{<|*"
WORD = re.compile(r"\S+")

# Digits in groups, with at most two separators between them; begun at the start of a run only.
GROUPED = re.compile(r"(?<![0-9])[+(]{0,2}[0-9]++(?:[\x20().-]{1,2}[0-9]++)+")
LABEL = re.compile(r"[^\W\d_].*[:=#]$")
DIGITS = re.compile(r"[0-9]+")
LETTERS = re.compile(r"[^\W\d_]+")

SPAN = "array<struct<kind:string,start:long,end:long,contexts:array<string>,value:string>>"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign with the local characters before it and the domain after it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1)
        if start < at and domain:
            done = domain.end()
            yield start, done
            at = text.find("@", done)
        else:
            # A local part has no at sign, so none starts before this one.
            done = at + 1
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def octet(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end, by kind as listed and by start."""
    found = []
    if "@" in text:
        found += [("email", s, e) for s, e in emails(text)]
    if "." in text:
        for m in ADDRESS.finditer(text):
            if all(octet(part) for part in m.groups()):
                found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def contexts_of(text: str, start: int, end: int) -> list[str]:
    """The patterns in front of a value, from a bounded stretch of text."""
    line = text[max(0, start - 80) : start]
    words = line[line.rfind("\n") + 1 :].lower().rstrip(EDGES_BEFORE).split()
    found = []
    plain = [DIGITS.sub("9", w.strip(EDGES)) for w in words[-2:]]
    if len(plain) == 2 and all(plain):
        found.append(" ".join(plain))
    if words and LABEL.match(words[-1]):
        label = DIGITS.sub("9", words[-1])
        # Marked, so that no two words look like a label.
        found += [f"|{label}", f"|{label}|{shape_of(text[start:end])}"]
    return found


def shape_of(value: str) -> str:
    """The value with runs of digits and of letters made equal."""
    return LETTERS.sub("a", DIGITS.sub("9", value))


def candidates(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Groups of digits, and words with digits or an at sign, that touch no base span."""
    spans = sorted((s, e) for _, s, e in taken)
    found = []
    for group in GROUPED.finditer(text):
        digits = sum(c.isdigit() for c in group[0])
        if digits >= FEWEST_GROUPED_DIGITS:
            found.append((group.start(), group.end()))
    done = 0
    for mark in MARK.finditer(text):
        if mark.start() < done:
            continue
        start = mark.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        word = WORD.match(text, start)
        done = word.end()
        value = word[0].strip(EDGES)
        if len(value) >= SHORTEST_CANDIDATE:
            start = text.index(value, start)
            found.append((start, start + len(value)))
    # Of those that overlap, the one that begins first and reaches farthest.
    next_span, done = 0, 0
    for start, end in sorted(found, key=lambda f: (f[0], -f[1])):
        if start < done:
            continue
        while next_span < len(spans) and spans[next_span][1] <= start:
            next_span += 1
        if next_span == len(spans) or spans[next_span][0] >= end:
            done = end
            yield start, end


def mentions(text: str | None) -> list[dict]:
    """Base spans with their kind, and candidates without one."""
    if not text:
        return []
    base = base_spans(text)
    every = base + [(None, s, e) for s, e in candidates(text, base)]
    return [
        {"kind": k, "start": s, "end": e, "contexts": contexts_of(text, s, e), "value": text[s:e].lower()}
        for k, s, e in every
    ]


def read_mentions(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, a key of the text, base spans and candidates.

    Values leave this step as hashes only.
    """

    @F.pandas_udf(SPAN)
    def mentions_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(mentions)

    def hashed(m: Column) -> Column:
        return F.struct(
            m["kind"].alias("kind"),
            m["start"].alias("start"),
            m["end"].alias("end"),
            F.transform(m["contexts"], lambda c: F.xxhash64(c)).alias("patterns"),
            F.xxhash64(m["value"]).alias("instance"),
        )

    return docs.select(
        "doc_id", text_key(F.col("text")).alias("_text"), mentions_of("text").alias("_found")
    ).select("doc_id", "_text", F.transform("_found", hashed).alias("_found"))


def scored_instances(
    mentioned: DataFrame, support: float, reliable: float, accepted: float, caution: float
) -> DataFrame:
    """instance, kind and score of the candidates that patterns introduce."""
    edges = cut(
        mentioned.select(F.explode("_found").alias("m"))
        .select(F.explode("m.patterns").alias("pattern"), "m.instance", "m.kind")
        .groupBy("pattern", "instance")
        .agg(F.max("kind").alias("seed"))
    )
    seeds = edges.where("seed is not null").groupBy("instance").agg(F.max("seed").alias("seed"))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    seeds = cut(seeds.select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")))
    known, before = seeds, 0
    while True:
        patterns = (
            edges.select("pattern", "instance")
            .join(known, "instance")
            .groupBy("pattern", "kind")
            .agg(F.sum("score").alias("total"))
            .where(F.col("total") >= support)
            .join(sizes, "pattern")
            .withColumn("confidence", lower_bound(F.col("total"), F.col("size"), caution))
            .where(F.col("confidence") >= reliable)
        )
        found = (
            edges.where("seed is null")
            .join(patterns.select("pattern", "kind", "confidence"), "pattern")
            .groupBy("instance", "kind")
            .agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score"))
            .join(seeds.select("instance"), "instance", "left_anti")
        )
        found = cut(found)
        # Scores only rise, as instances and reliable patterns are added; so this ends.
        sure = found.where(F.col("score") >= accepted).count()
        if sure <= before:
            return found
        known, before = seeds.unionByName(found), sure


def lower_bound(right: Column, size: Column, caution: float) -> Column:
    """The lower end of Wilson's interval for the share of ``right`` in ``size``."""
    share, square = right / size, caution * caution
    middle = share + square / (2 * size)
    spread = caution * F.sqrt(F.greatest(share * (1 - share), F.lit(0.0)) / size + square / (4 * size * size))
    return (middle - spread) / (1 + square / size)


def discovered(
    mentioned: DataFrame,
    support: float = SUPPORT,
    reliable: float = RELIABLE,
    accepted: float = ACCEPTED,
    caution: float = CAUTION,
) -> DataFrame:
    """doc_id, text key and the spans that patterns add, per document with any."""
    scores = scored_instances(mentioned, support, reliable, accepted, caution)
    best = (
        scores.where(F.col("score") >= accepted)
        .groupBy("instance")
        .agg(F.max(F.struct("score", "kind"))["kind"].alias("_kind"))
    )
    return (
        mentioned.select("doc_id", "_text", F.explode("_found").alias("m"))
        .where("m.kind is null")
        .select("doc_id", "_text", "m.start", "m.end", "m.instance")
        .join(best, "instance")
        .groupBy("doc_id", "_text")
        .agg(F.collect_set(F.struct(F.col("_kind").alias("kind"), "start", "end")).alias("_added"))
        .withColumnsRenamed({"doc_id": "_id", "_text": "_added_text"})
    )


def _same_row(doc_id: Column, text: Column, its: dict[str, Column]) -> Column:
    return doc_id.eqNullSafe(its["_id"]) & (text == its["_added_text"])


def listed(spans: Column) -> Column:
    """``kind:start:end`` by kind as listed and by start, joined by commas."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    ordered = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(rank[s["kind"]], s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
        )
    )
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def detected(docs: DataFrame, **settings) -> DataFrame:
    """Counts and digest of the base spans, and all spans, per document."""
    mentioned = cut(read_mentions(docs))
    added = discovered(mentioned, **settings)
    plain = F.transform(
        F.filter("_found", lambda m: m["kind"].isNotNull()),
        lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")),
    )
    same = _same_row(mentioned["doc_id"], mentioned["_text"], {c: F.col(c) for c in added.columns})
    joined = mentioned.join(added, same, "left").withColumn("_base", plain)
    kinds = F.col("_base.kind")
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS
    ]
    every = F.concat("_base", F.coalesce("_added", F.filter("_base", lambda s: F.lit(False))))
    return joined.select(
        "doc_id", *counts, F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(every).alias("spans")
    )


def masked_text(text: str | None, added: list | None) -> str | None:
    """The text with every span replaced by its kind in brackets."""
    if not text:
        return text
    spans = base_spans(text) + [(s["kind"], s["start"], s["end"]) for s in (added if added is not None else [])]
    if not spans:
        return text
    parts, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            parts += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def masked(docs: DataFrame, **settings) -> DataFrame:
    """The documents with personal data replaced; n_chars follows the text."""

    @F.pandas_udf("string")
    def replaced(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, added in batches:
            yield pd.Series([masked_text(t, a) for t, a in zip(texts, added, strict=True)], dtype=object)

    mentioned = cut(read_mentions(docs))
    added = small_enough(cut(discovered(mentioned, **settings)))
    sides, its = apart(added, docs)
    joined = docs.join(sides, _same_row(docs["doc_id"], text_key(docs["text"]), its), "left")
    kind = docs.schema["n_chars"].dataType
    return joined.select(
        *[docs[c] if c != "text" else replaced(docs["text"], its["_added"]).alias("text") for c in docs.columns]
    ).withColumn("n_chars", F.length("text").cast(kind))

import hashlib
import random
import re
import time

import pytest

from cohortry.llm import personal_data
from cohortry.llm.personal_data import base_spans, detected, luhn, masked, masked_text, mentions
from tests.conftest import SMALL
from tests.llm.edges import awkward, documents, nothing, same_schema

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if fits:
                found.append((kind, m.start(), m.end()))
    return found


def digest(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


@pytest.mark.parametrize("letters", ["a.@-_%+ 1", "0123.9 ", "+1 ()-.05", "45123- 0", "a@.b1+ \n"])
def test_base_spans_are_those_of_the_plain_patterns(letters):
    draw = random.Random(7)
    for _ in range(5_000):
        text = "".join(draw.choices(letters, k=draw.randint(1, 40)))
        assert base_spans(text) == brute(text), text


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_given_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in detected(docs).collect():
        expected = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(digest(expected).encode()).hexdigest()
        for kind in PATTERNS:
            assert r[f"n_{kind}"] == sum(k == kind for k, _, _ in expected)
        held = set(r["spans"].split(",")) - {""}
        assert {f"{k}:{s}:{e}" for k, s, e in expected} <= held


def card(number):
    """A number of 16 digits that passes the Luhn check."""
    stem = f"{number:015d}"
    return next(stem + str(d) for d in range(10) if luhn(stem + str(d)))


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"text {i} customer card: {card(10**14 + i)} was used", "s") for i in range(8)]
    rows += [(20, "again customer card: 1234567812345678 failed", "s")]
    rows += [(30, "the order number 12345678123 is no card", "s")]
    found = {r["doc_id"]: r for r in detected(documents(spark, rows)).collect()}
    text = rows[8][1]
    at = text.index("1234")
    assert found[20]["spans"] == f"card:{at}:{at + 16}" and found[20]["n_card"] == 0
    assert found[30]["spans"] == "" and found[0]["n_card"] == 1
    assert found[20]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_labels_at_the_start_of_a_line_find_grouped_numbers(spark):
    """Seeds behind one label, and identifiers of forms that no base pattern takes."""
    rows = [(i, f"some text {i}\nPhone: +49 30 {1000000 + 7919 * i}\nmore", "s") for i in range(9)]
    unseen = ["030 123 4567", "(030) 987-6543", "030.555.1234", "0305551299"]
    rows += [(20 + i, f"other text\nphone: {value}", "s") for i, value in enumerate(unseen[:1])]
    rows += [(40 + i, f"a list of {100 + i} 200 30{i}0 4000 things", "s") for i in range(9)]
    found = {r["doc_id"]: r["spans"] for r in detected(documents(spark, rows)).collect()}
    for i, value in enumerate(unseen[:1]):
        at = rows[9 + i][1].index(value)
        assert found[20 + i] == f"phone:{at}:{at + len(value)}"
    assert all(found[i] == "" for i in range(40, 49)) and all(found[i].count("phone") == 1 for i in range(9))


def test_recall_and_precision_on_unseen_forms(spark):
    """Many seeds of two kinds, a few identifiers of unseen forms, and numbers that are none."""
    draw = random.Random(11)
    rows, wanted = [], {}
    for i in range(120):
        kind = ("card", "phone")[i % 2]
        seed = card(10**14 + draw.randrange(10**12)) if kind == "card" else f"+1 555 {draw.randrange(10**6, 10**7)}"
        value = seed
        if i % 12 >= 10:
            value = f"{draw.randrange(10**4)} {draw.randrange(10**6, 10**7)}" if kind == "phone" else f"9{draw.randrange(10**10, 10**11)}"
        text = f"{draw.choice(['alpha', 'beta'])} {i} {kind} no: {value} end"
        rows.append((i, text, "s"))
        if value != seed:
            at = text.index(value)
            wanted[i] = f"{kind}:{at}:{at + len(value)}"
    rows += [(1000 + i, f"order no. {draw.randrange(10**9, 10**10)} shipped", "s") for i in range(60)]
    found = {r["doc_id"]: r["spans"] for r in detected(documents(spark, rows)).where("n_card + n_phone = 0").collect()}
    hits = sum(found.get(i) == spans for i, spans in wanted.items())
    given = sum(spans != "" for spans in found.values())
    assert len(wanted) == 20 and hits >= 0.9 * len(wanted) and hits >= 0.95 * given


def brute_scores(texts, support=3.0, reliable=0.6, accepted=0.6, z=1.28):
    """Scores of candidates by the definition, pattern by pattern."""
    seeds, edges = {}, set()
    for text in texts:
        for m in mentions(text):
            for pattern in m["contexts"]:
                edges.add((pattern, m["value"]))
                if m["kind"]:
                    seeds[m["value"]] = max(seeds.get(m["value"], ""), m["kind"])
    known, before = {(v, k): 1.0 for v, k in seeds.items()}, 0
    while True:
        reliable_patterns = {}
        for pattern in {p for p, _ in edges}:
            values = {v for p, v in edges if p == pattern}
            for kind in personal_data.KINDS:
                total = sum(known.get((v, kind), 0.0) for v in values)
                share, n = total / len(values), len(values)
                middle, spread = share + z * z / (2 * n), z * (max(share * (1 - share), 0) / n + z * z / (4 * n * n)) ** 0.5
                low = (middle - spread) / (1 + z * z / n)
                if total >= support and low >= reliable:
                    reliable_patterns[pattern, kind] = low
        found = {}
        for (pattern, kind), low in reliable_patterns.items():
            for p, v in edges:
                if p == pattern and v not in seeds:
                    found[v, kind] = 1 - (1 - found.get((v, kind), 0.0)) * (1 - min(low, 0.999))
        sure = sum(score >= accepted for score in found.values())
        if sure <= before:
            return found
        known, before = {**{(v, k): 1.0 for v, k in seeds.items()}, **found}, sure


def test_pattern_scores_match_brute_force(spark):
    draw = random.Random(3)
    texts = []
    for _ in range(150):
        lead = draw.choice(["call me", "card:", "phone:", "Tel:", "my number", "at"])
        seed = card(10**14 + draw.randrange(50)) if "c" in lead else f"+1 555 {1000000 + draw.randrange(40)}"
        value = seed if draw.random() < 0.9 else f"AB{draw.randrange(30)}77x9"
        texts.append(f"{draw.choice(['x', 'so please'])} {lead} {value} ok")
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    scored = personal_data.scored_instances(personal_data.read_mentions(docs), 3.0, 0.6, 0.6, 1.28)
    values = spark.createDataFrame([(v,) for v in {m["value"] for t in texts for m in mentions(t)}], "value string")
    named = scored.join(values.selectExpr("value", "xxhash64(value) AS instance"), "instance")
    found = {(r["value"], r["kind"]): r["score"] for r in named.collect()}
    wanted = brute_scores(texts)
    assert found.keys() == wanted.keys() and len(wanted) > 0
    assert all(found[k] == pytest.approx(wanted[k]) for k in wanted)


def test_a_pattern_that_also_introduces_other_things_finds_nothing(spark):
    rows = [(i, f"some number is {card(10**14 + i)} here", "s") for i in range(4)]
    rows += [(10 + i, f"some number is AB{i}7C99x{i} here", "s") for i in range(9)]
    assert all(r["spans"] == "" for r in detected(documents(spark, rows)).where("n_card = 0").collect())


def test_masking(spark):
    text = "Mail a.b@c.de or +1 (555) 123-4567, host 10.0.0.255 not 10.0.0.256, card 4111 1111 1111 1111."
    docs = documents(spark, [(1, text, "s"), (2, None, "s"), (3, "", "s"), (4, "clean", "s")])
    rows = {r["doc_id"]: r for r in masked(docs).collect()}
    assert rows[1]["text"] == "Mail [email] or [phone], host [ip] not 10.0.0.256, card [card]."
    assert rows[1]["n_chars"] == len(rows[1]["text"])
    assert rows[2]["text"] is None and rows[3]["text"] == "" and rows[4]["text"] == "clean"
    assert same_schema(masked(docs), docs)


def test_overlapping_spans_are_masked_once():
    text = "+4111 1111 1111 1111"
    assert {k for k, _, _ in base_spans(text)} == {"card"}
    assert masked_text("x 1.2.3.4@mail.com", None) == "x [email]"


def test_awkward_rows_and_long_runs(spark):
    rows = detected(awkward(spark)).collect()
    assert len(rows) == 11 and all(r["spans"] == "" for r in rows)
    assert detected(nothing(spark)).count() == 0 and masked(nothing(spark)).count() == 0
    assert mentions("1" * 200_000 + "a@" * 50_000) is not None


def test_long_runs_are_read_once():
    for text in ("1" * 200_000, "1 " * 100_000, "+(" * 100_000, "1 -" * 70_000, "(1" * 100_000):
        begun = time.perf_counter()
        mentions(text)
        assert time.perf_counter() - begun < 5, text[:4]


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs = awkward(spark)
    sent = sorted(masked(docs).collect(), key=str)
    monkeypatch.setattr(personal_data, "small_enough", lambda df: df)
    assert sorted(masked(docs).collect(), key=str) == sent

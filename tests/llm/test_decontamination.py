import random

import duckdb
import pandas as pd
import pytest

from cohortry.llm import decontamination
from cohortry.llm.queries import DECONTAMINATION_SQL
from tests.compare import difference
from tests.llm.edges import WORDS, awkward, documents, nothing, same_schema


def bench(spark, rows):
    frame = spark.createDataFrame(rows, "item_id long, text string")
    return frame.selectExpr("*", "'x' AS words", "1 AS length", "'y' AS `window`", "'z' AS item")


def in_sql(docs, items):
    connection = duckdb.connect()
    connection.register("d", pd.DataFrame(docs, columns=["doc_id", "text", "source"])[["doc_id", "text"]])
    connection.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text FROM d")
    ids = pd.array([i for i, _ in items], dtype="Int64")
    connection.register("b", pd.DataFrame({"item_id": ids, "text": [t for _, t in items]}))
    connection.execute("CREATE TABLE benchmark AS SELECT item_id::BIGINT AS item_id, text::VARCHAR AS text FROM b")
    return connection


@pytest.mark.parametrize("seed", range(3))
def test_random_overlaps_match_sql(spark, seed):
    draw = random.Random(seed)
    few = WORDS[:6]  # many chance repeats
    items = [(i, " ".join(draw.choices(few if i % 2 else WORDS, k=draw.randint(1, 30)))) for i in range(12)]
    docs = []
    for i in range(40):
        words = draw.choices(few if i % 3 == 0 else WORDS, k=draw.randint(0, 60))
        source = items[draw.randrange(12)][1].split()
        at = draw.randrange(len(source))
        words[5:5] = source[at : at + draw.randint(1, 30)]
        docs.append((i, ", ".join(words).upper() if i % 2 else " ".join(words), "s"))
    judged = decontamination.judged(documents(spark, docs), bench(spark, items)).drop("_text")
    assert difference(judged, in_sql(docs, items), DECONTAMINATION_SQL) is None


def test_every_long_shared_span_is_found(spark):
    """A span of 13 words at any place and distance from the ends."""
    item = " ".join(WORDS[:40])
    docs = [(i, " ".join(WORDS[300 : 300 + i] + WORDS[i : i + 13] + WORDS[200:220]), "s") for i in range(27)]
    docs += [(100, " ".join(WORDS[5:17]), "s")]
    rows = decontamination.judged(documents(spark, docs), bench(spark, [(1, item)])).collect()
    hits = {r["doc_id"]: r["n_hit"] for r in rows}
    assert hits == {**{i: 13 for i in range(27)}, 100: 0}


def test_awkward_rows(spark):
    items = [(1, " ".join(WORDS[:60])), (2, None), (3, ""), (4, "ONE"), (None, "same same same"), (5, "...")]
    rows = decontamination.judged(awkward(spark), bench(spark, items)).collect()
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in rows}
    assert len(rows) == 11
    assert found[1] == found[2] == (60, 60, 1, True)
    assert found[3] == found[4] == found[5] == (0, 0, 0, False)
    assert found[7] == (1, 1, 1, True) and found[10] == (500, 500, 1, True)
    assert found[6] == (16000, 2400, 1, True) and found[None] == (60, 0, 0, False)


def test_one_doc_id_with_two_texts(spark):
    docs = documents(spark, [(1, " ".join(WORDS[:20]), "s"), (1, "clean words", "s")])
    rows = decontamination.judged(docs, bench(spark, [(1, " ".join(WORDS[:20]))])).collect()
    assert sorted(r["n_hit"] for r in rows) == [0, 20]


def test_empty_tables_and_the_filter(spark):
    items = bench(spark, [(1, " ".join(WORDS[:60]))])
    assert decontamination.judged(nothing(spark), items).count() == 0
    assert decontamination.judged(awkward(spark), items.where("false")).where("n_hit > 0").count() == 0
    kept = decontamination.without_contaminated(awkward(spark), items)
    assert same_schema(kept, awkward(spark))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 3, 4, 5, 7, 7, 9, 10]


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    items = bench(spark, [(1, " ".join(WORDS[:60])), (4, "one")])
    sent = sorted(decontamination.judged(awkward(spark), items).collect(), key=str)
    monkeypatch.setattr(decontamination, "small_enough", lambda df: df)
    assert sorted(decontamination.judged(awkward(spark), items).collect(), key=str) == sent

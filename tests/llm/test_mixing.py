import random

import pytest

from cohortry.llm import mixing
from tests.llm.edges import awkward, documents, nothing, same_schema


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Capping and sharing again until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return {**capped, **share}
        capped.update({s: most * sizes[s] for s in over})


@pytest.mark.parametrize("seed", range(4))
def test_targets_match_repeated_capping(spark, seed):
    draw = random.Random(seed)
    sizes = {f"s{i}": int(10 ** draw.uniform(0, 5)) for i in range(9)} | {None: 50, "empty": 0}
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    found = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
    expected = brute_targets(sizes)
    assert found.keys() == expected.keys()
    for source, target in expected.items():
        assert found[source] == pytest.approx(target, rel=1e-9)
    assert sum(found.values()) == pytest.approx(sum(sizes.values()))


def test_awkward_documents(spark):
    rows = mixing.planned(awkward(spark)).collect()
    assert len(rows) == 11
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[3]["size"] == by_id[4]["size"] == by_id[5]["size"] == 0
    assert by_id[4]["target"] == 0 and by_id[4]["source_size"] == 0
    for r in rows:
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    assert mixing.planned(nothing(spark)).count() == 0


def test_taken_words_come_near_targets_and_reruns_agree(spark):
    draw = random.Random(3)
    rows = [(i, "w " * draw.randint(1, 40), f"s{draw.choice([0, 0, 0, 1, 2, 3])}") for i in range(4000)]
    docs = documents(spark, rows)
    first = mixing.planned(docs)
    by_source = first.groupBy("target", "source_size").agg({"taken": "sum"}).collect()
    for r in by_source:
        assert r["sum(taken)"] == pytest.approx(r["target"], rel=0.1)
    again = mixing.planned(docs.repartition(7))
    assert sorted(first.collect()) == sorted(again.collect())
    # The mix itself holds each document as often as planned.
    mix = mixing.mixed(docs)
    assert same_schema(mix, docs)
    copies = {r["doc_id"]: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    for r in first.collect():
        assert copies.get(r["doc_id"], 0) * r["size"] == r["taken"]

"""Operators against plain Python on seeded random data, many cases per job."""

import collections
import datetime as dt
import math
import random
import statistics

import pytest

from cohortry.operators import experiment as exp
from cohortry.operators import offers as off
from cohortry.operators import uplift as up
from tests.support import rows

START = dt.date(2020, 1, 1)


def variance(kind, r):
    if kind == "proportion":
        return r["value"] * (1 - r["value"]) / r["n"]
    if kind == "sum":
        return r["n"] * r["sd"] ** 2
    if kind == "mean":
        return r["sd"] ** 2 / r["n"]
    spread = r["n"] * (r["sn"] ** 2 + r["value"] ** 2 * r["sd"] ** 2 - 2 * r["value"] * r["cov"])
    return max(spread, 0.0) / r["den"] ** 2


@pytest.mark.parametrize("kind", ["proportion", "sum", "mean", "ratio"])
def test_significance(spark, kind):
    rng = random.Random(kind)
    data = []
    for cell in range(60):
        for variant in ("control", "treatment", "other")[rng.randrange(0, 2) :]:
            sn, sd = rng.uniform(0, 5), rng.uniform(0, 5)
            data.append(
                (cell, variant, rng.choice([0.0, rng.random()]), rng.randrange(1, 500),
                 rng.uniform(10, 1000), sn, sd, rng.uniform(-1, 1) * sn * sd)
            )
    schema = "cell int, variant string, value double, n long, den double, sn double, sd double, cov double"
    names = [c.split()[0] for c in schema.split(", ")]
    metric = exp.Metric("m", "value", "n", kind, "sd", "den", "sn", "sd", "cov")
    got = {
        (r["cell"], r["variant"]): r
        for r in rows(exp.with_significance(spark.createDataFrame(data, schema), metric, ["cell"]))
    }
    arms = {(d[0], d[1]): dict(zip(names, d)) for d in data}
    for (cell, variant), arm in arms.items():
        found, control = got[cell, variant], arms.get((cell, "control"))
        if control is None:
            assert found["margin_abs_m"] is None and found["m_stat_sig"] == "non-stat-sig"
            continue
        margin = 1.96 * math.sqrt(variance(kind, arm) + variance(kind, control))
        delta = arm["value"] - control["value"]
        assert found["margin_abs_m"] == pytest.approx(margin, abs=1e-9)
        assert found["IC_lower_abs_m"] == pytest.approx(delta - margin, abs=1e-9)
        if control["value"] == 0:
            assert found["IC_upper_rel_m"] is None
        else:
            assert found["IC_upper_rel_m"] == pytest.approx((delta + margin) / control["value"])
        expected = "stat-sig" if delta - margin > 0 or delta + margin < 0 else "non-stat-sig"
        assert found["m_stat_sig"] == expected


def test_uplift(spark):
    rng = random.Random(5)
    arms = ["control", "treatment", "other"]
    exposure = [
        (c, rng.choice(arms), START + dt.timedelta(rng.randrange(-20, 90)))
        for c in range(40)
        for _ in range(rng.randrange(1, 3))
    ]
    facts = [
        (rng.randrange(45), START + dt.timedelta(rng.randrange(-30, 150)), float(rng.randrange(-50, 100)))
        for _ in range(600)
    ]
    first = {}
    for customer, variant, day in exposure:
        if day >= START:
            key = customer, variant
            first[key] = min(first.get(key, day), day)
    sums = collections.defaultdict(float)
    for customer, day, value in facts:
        for variant in arms:
            since = first.get((customer, variant))
            if since and day >= START and day >= since:
                sums[customer, variant, day.replace(day=1)] += value
    running, cumulative = collections.defaultdict(float), {}
    for customer, variant, period in sorted(sums, key=lambda k: (k[0], k[1], k[2])):
        running[customer, variant] += sums[customer, variant, period]
        cumulative[customer, variant, period] = running[customer, variant]

    exposure_df = spark.createDataFrame(exposure, "customer_id int, variant string, exposition_date date")
    facts_df = spark.createDataFrame(facts, "customer_id int, date date, total double")
    frames = up.metric_uplift(exposure_df, facts_df, up.Branch("t", "total"), str(START), grain="month")
    for values, stats, uplift in (
        (sums, frames.periodic_stats, frames.periodic_uplift),
        (cumulative, frames.cumulative_stats, frames.cumulative_uplift),
    ):
        cells = collections.defaultdict(list)
        for (_, variant, period), value in values.items():
            cells[period, variant].append(value)
        found = {(r["period"], r["variant"]): r for r in rows(stats)}
        assert set(found) == set(cells)
        for key, members in cells.items():
            assert found[key]["n_customers"] == len(members)
            assert found[key]["avg_metric"] == pytest.approx(statistics.fmean(members), abs=1e-9)
            if len(members) > 1:
                assert found[key]["std_metric"] == pytest.approx(statistics.stdev(members), abs=1e-9)
            else:
                assert found[key]["std_metric"] is None
        pairs = {k for k in cells if k[1] != "control" and (k[0], "control") in cells}
        differences = {(r["period"], r["variant"]): r["uplift"] for r in rows(uplift)}
        assert set(differences) == pairs
        for period, variant in pairs:
            expected = statistics.fmean(cells[period, variant]) - statistics.fmean(cells[period, "control"])
            assert differences[period, variant] == pytest.approx(expected, abs=1e-9)


def test_best_alternative(spark):
    rng = random.Random(9)
    data = [
        (i, rng.randrange(12), rng.choice("pq"), rng.choice("xyz"), 0.1, float(rng.randrange(4)), 0.2,
         START + dt.timedelta(rng.randrange(3)))
        for i in range(300)
    ]
    best = {}
    for row in data:
        rank = (-row[5], -row[7].toordinal(), row[3], row[0])
        if row[1] not in best or rank < best[row[1]][0]:
            best[row[1]] = (rank, row)
    df = spark.createDataFrame(
        data,
        "contract_id int, customer_id int, contracted_product string, alternative_product string, "
        "alternative_rate double, saving double, saving_pct double, contract_date date",
    )
    got = {r["customer_id"]: r for r in rows(off.best_alternative(df))}
    assert set(got) == set(best)
    for customer, (_, row) in best.items():
        found = got[customer]
        assert (found["contracted_product"], found["best_alternative_product"]) == (row[2], row[3])
        assert (found["max_saving"], found["last_contract_date"]) == (row[5], row[7])

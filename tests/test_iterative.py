import math
from collections import Counter, defaultdict

import pytest

from lakefold.plans import registry
from lakefold.plans.iterative import LogisticRegression, page_rank
from lakefold.sources.io import from_rows


def test_gradient_descent(spark):
    df = from_rows(spark, [(0.5, 0), (1.0, 0), (2.0, 0), (3.0, 1), (4.0, 1), (5.0, 1)], "x double, y int")
    m = LogisticRegression(0.5, 200, 0.0).fit(df, ["x"], "y")
    assert m.predict([0.5]) == 0 and m.predict([5.0]) == 1 and m.loss(df, "y") < 0.4
    assert [r.prediction for r in m.transform(df).orderBy("x").collect()][-1] == 1


def test_page_rank(spark):
    edges = from_rows(spark, [tuple(e) for e in ("AB", "AC", "BC", "CA", "DA", "DC", "EB", "FD")], "src string, dst string")
    ranks = {r.page: r.rank for r in page_rank(edges).collect()}
    want = {"A": 0.34981628, "B": 0.19492192, "C": 0.35901180, "D": 0.04625, "E": 0.025, "F": 0.025}
    assert sum(ranks.values()) == pytest.approx(1) and all(ranks[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


def test_page_rank_dangling(spark):
    ranks = {r.page: r.rank for r in page_rank(from_rows(spark, [("A", "B")], "src string, dst string"), iterations=100, tolerance=1e-10).collect()}
    assert ranks["A"] == pytest.approx(0.35087719, abs=1e-6) and ranks["B"] == pytest.approx(0.64912281, abs=1e-6)


SF = "/root/testdata/sf0.001"


def test_page_rank_of_all_customers(spark):
    """The registered query against plain rounds until no rank moves by 1e-8."""
    got = {r.page: r.rank for r in registry.QUERIES["pagerank_converged"](spark, SF).collect()}
    assert {f"c{r.c_custkey}" for r in spark.read.parquet(f"{SF}/customer.parquet").collect()} <= set(got)
    edges = [(r.src, r.dst) for r in registry.trade_edges(spark, SF).collect()]
    out, n = Counter(a for a, _ in edges), len(got)
    ranks = dict.fromkeys(got, 1 / n)
    for _ in range(50):
        came = defaultdict(float)
        for a, b in edges:
            came[b] += ranks[a] / out[a]
        lost = sum(r for p, r in ranks.items() if p not in out)
        new = {p: 0.15 / n + 0.85 * (came[p] + lost / n) for p in ranks}
        moved, ranks = max(abs(new[p] - ranks[p]) for p in ranks), new
        if moved < 1e-8:
            break
    total = sum(ranks.values())
    assert sum(got.values()) == pytest.approx(1) and all(got[p] == pytest.approx(r / total, rel=1e-6) for p, r in ranks.items())


def test_logistic_regression_with_default_rounds(spark):
    got = registry.QUERIES["logreg_default_rounds"](spark, SF).first()
    rows = [(r.f0, r.f1, r.y) for r in registry._labelled(spark, SF).collect()]
    w = [0.0, 0.0, 0.0]
    for _ in range(50):
        errors = [1 / (1 + math.exp(-(w[0] * a + w[1] * b + w[2]))) - y for a, b, y in rows]
        steps = [0.1 * sum(e * x for e, x in zip(errors, xs)) / len(rows) for xs in ([r[0] for r in rows], [r[1] for r in rows], [1.0] * len(rows))]
        w = [a - s for a, s in zip(w, steps)]
        if abs(steps[0]) + abs(steps[1]) < 1e-6:
            break
    assert [got.w0, got.w1, got.bias] == pytest.approx(w, rel=1e-6)

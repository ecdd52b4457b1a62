import math

import numpy as np
import pandas as pd
import pytest

from telar.llm.mixing import mix, plan, poisson_inverse, rate_for


def test_inverse_is_the_distribution():
    u = (np.arange(100_000) + 0.5) / 100_000
    for rate in (0.1, 1.0, 4.0):
        k = poisson_inverse(u, np.array(rate), np.array(50))
        for j in range(8):
            assert abs((k == j).mean() - math.exp(-rate) * rate**j / math.factorial(j)) < 1e-3
        assert poisson_inverse(u, np.array(rate), np.array(2)).max() <= 2
    assert (poisson_inverse(u[:5], np.array(np.inf), np.array(3)) == 3).all()


@pytest.mark.parametrize("mean, cap", [(0.5, 1), (0.2, 4), (2.5, 6), (0.0, 3)])
def test_rate_for_capped_mean(mean, cap):
    u = (np.arange(200_000) + 0.5) / 200_000
    assert abs(poisson_inverse(u, np.array(rate_for(mean, cap)), np.array(cap)).mean() - mean) < 2e-3


def test_plan():
    p = plan(pd.DataFrame({"tokens": [1000.0, 100.0, 0.0], "weight": [0.4, 0.4, 0.2], "cap": [1, 2, 5]}))
    assert p["target"].tolist() == pytest.approx([200, 200, 0])
    assert np.isinf(p["rate"][1]) and p["rate"][2] == 0
    short = plan(pd.DataFrame({"tokens": [1000.0, 100.0], "weight": [0.5, 0.5], "cap": [1, 2]}), total=2000)
    assert short["target"].tolist() == [1000, 200] and short["limit"].tolist() == ["", "cap"]
    # A short source goes to its cap; the others share the rest by their weights.
    large = plan(pd.DataFrame({"tokens": [1000.0, 100.0, 4000.0, 0.0], "weight": [0.25, 0.25, 0.5, 0.1], "cap": [2, 2, 1, 3]}), total=2000)
    assert large["target"].tolist() == pytest.approx([600, 200, 1200, 0]) and large["limit"].tolist() == ["", "cap", "", "empty"]
    huge = plan(pd.DataFrame({"tokens": [10.0, 10.0], "weight": [0.9, 0.1], "cap": [1, 3]}), total=1e9)
    assert huge["target"].tolist() == [10, 30]


def data(spark, n=4000):
    return spark.range(n).selectExpr("id", "case when id % 10 = 0 then 'chica' when id % 7 = 0 then null else 'grande' end as source", "cast(50 + id % 40 as int) as size", "'z' as mix_u0")


def test_shares_caps_and_rows(spark):
    targets = spark.createDataFrame([("grande", 0.5, 1), ("chica", 0.5, 3), ("chica", 0.1, 3), ("vacia", 0.3, 9), (None, 0.2, 1)], "s string, w double, m int")
    rows, report = mix(data(spark), targets, "id", "source", "size", "s", "w", "m")
    used = rows.groupBy("id", "source").count().toPandas()
    assert used[used.source == "grande"]["count"].max() == 1 and used[used.source == "chica"]["count"].max() <= 3
    r = {x.source: x for x in report.collect()}
    assert set(r) == {"grande", "chica", "vacia"} and r["vacia"].tokens == 0
    assert abs(r["grande"].actual_share - 0.5) < 0.01 and abs(r["chica"].actual_share - 0.5) < 0.01
    assert rows.columns == ["id", "source", "size", "mix_u0", "mix_copy", "mix_order"]
    order = [x.mix_order for x in rows.collect()]
    assert order == sorted(order)
    again = sorted((x.id, x.mix_copy) for x in mix(data(spark).repartition(7), targets, "id", "source", "size", "s", "w", "m")[0].collect())
    assert again == sorted((x.id, x.mix_copy) for x in rows.collect())


def test_empty(spark):
    targets = spark.createDataFrame([("grande", 1.0, 1)], "s string, w double, m int")
    rows, report = mix(data(spark).limit(0), targets, "id", "source", "size", "s", "w", "m")
    assert rows.count() == 0 and [x.tokens for x in report.collect()] == [0]
    rows, report = mix(data(spark), targets.limit(0), "id", "source", "size", "s", "w", "m")
    assert rows.count() == 0 and report.count() == 0


def test_a_total_beyond_the_short_source(spark):
    """Replication and shuffle at a size where most documents are used: shares within a hundredth of what each source can have."""
    targets = spark.createDataFrame([("grande", 0.6, 2), ("chica", 0.4, 3), ("vacia", 0.3, 9)], "s string, w double, m int")
    total = 300_000.0
    rows, report = mix(data(spark), targets, "id", "source", "size", "s", "w", "m", total=total)
    r = {x.source: x for x in report.collect()}
    assert r["chica"].reason == "cap" and r["vacia"].reason == "empty" and r["grande"].reason is None
    assert all(abs(x.actual_share - x.effective_share) < 0.01 for x in r.values())
    assert abs(sum(x.tokens for x in r.values()) - total) < 0.01 * total
    used = rows.groupBy("source", "id").count().toPandas()
    docs = data(spark).groupBy("source").count().toPandas().set_index("source")["count"]
    for name in ("grande", "chica"):
        assert r[name].unused_documents == docs[name] - len(used[used.source == name]) and r[name].copies == used[used.source == name]["count"].sum()
    assert used[used.source == "chica"]["count"].eq(3).all() and used["count"].max() <= 3

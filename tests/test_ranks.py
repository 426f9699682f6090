"""Order statistics and leave-one-out kernel against NumPy, in the array and the distributed form."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import loo, ranks


def groups(spark):
    rnd = random.Random(7)
    sizes = {"a": 1, "b": 2, "c": 3, "d": 20, "e": 21, "hot": 400}
    rows = [(g, f"{g}{i}", f"ch{i % 3}", float(rnd.choice([1, 2, 2, 3, rnd.gauss(5, 2), 1e6]))) for g, n in sizes.items() for i in range(n)]
    return rows, spark.createDataFrame(rows, "g STRING, id STRING, ch STRING, x DOUBLE")


@pytest.mark.parametrize("limit", [100000, 15])
def test_loo_and_quantiles(spark, limit):
    spark.conf.set("emberline.group.limit", str(limit))
    rows, df = groups(spark)
    by = {}
    for g, i, c, x in rows:
        by.setdefault(g, []).append((i, c, x))
    got = {r["id"]: r for r in loo.with_loo(df, ["g"], "x").collect()}
    for g, members in by.items():
        for i, (id_, _, x) in enumerate(members):
            peers = np.array([m[2] for k, m in enumerate(members) if k != i])
            r = got[id_]
            assert r["loo_n"] == len(peers)
            if len(peers):
                assert r["loo_med"] == pytest.approx(np.median(peers), abs=1e-12)
                assert r["loo_mad"] == pytest.approx(np.median(abs(peers - np.median(peers))), abs=1e-12)
            else:
                assert r["loo_med"] is None
    q = {r["g"]: r for r in ranks.group_quantiles(df, ["g"], "x", [0.05, 0.5, 0.9]).collect()}
    for g, members in by.items():
        assert list(q[g]["q"]) == pytest.approx(list(np.quantile([m[2] for m in members], [0.05, 0.5, 0.9])))
    out = {(r["g"], r["ch"]): r for r in ranks.leave_label_out_median(df, ["g"], "ch", "x").collect()}
    for g, members in by.items():
        for ch in {m[1] for m in members}:
            rest = [m[2] for m in members if m[1] != ch]
            r = out[(g, ch)]
            assert r["n_out"] == len(rest)
            assert (r["med_out"] is None) if not rest else r["med_out"] == pytest.approx(np.median(rest))


@pytest.mark.parametrize("limit", [100000, 15])
def test_rank_merge(spark, limit):
    spark.conf.set("emberline.group.limit", str(limit))
    rows, df = groups(spark)
    obs = df.where("id LIKE '%5'").select("g", "id", F.col("x").alias("s"))
    got = ranks.count_at_least(obs, df.select("g", F.col("x").alias("s")), ["g"], "s").collect()
    for r in got:
        ref = [x for g, _, _, x in rows if g == r["g"]]
        assert r["n_ge"] == sum(v >= r["s"] for v in ref) and r["n_ref"] == len(ref)


@pytest.mark.parametrize("kind", ["fresh", "far", "copies", "tiny"])
def test_record_of_a_large_group_gathers_few_rows(spark, kind):
    """Fresh values in a large lot: the record equals the sorted one, and no row is repeated for every centre."""
    rnd = random.Random(3)
    draw = {
        "fresh": lambda i: rnd.gauss(3, 0.1),
        "far": lambda i: rnd.gauss(0, 1e-3) + (1e4 if i % 2 else -7.0),
        "copies": lambda i: float(rnd.choice([-2, 0, 0, 1, 5])),
        "tiny": lambda i: rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-300, 300),
    }[kind]
    sizes = {"a": 300, "b": 301, "c": 5}
    rows = [(g, draw(i)) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "g STRING, x DOUBLE")
    spark.conf.set("emberline.group.limit", "100000")
    want = {r.g: r.loo for r in loo.loo_record(df, ["g"], "x", False).collect()}
    spark.conf.set("emberline.group.limit", "60")
    widest = []
    cells = loo.value_cells

    def spy(part, keys):
        widest.append(part.count())
        return cells(part, keys)

    loo.value_cells = spy
    try:
        got = {r.g: r.loo for r in loo.loo_record(df, ["g"], "x").collect()}
    finally:
        loo.value_cells = cells
    assert got == want
    assert max(widest) <= (4 if kind == "far" else 1) * len(rows)

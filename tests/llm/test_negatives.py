"""Hard negatives against a plain rewrite and against SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import negatives, queries


def plain(rows, anchors, options=negatives.MiningOptions()):
    """(anchor_id, positive_id, rank, negative_id, scores) by sorting all rows for each anchor; ids are unique."""
    use = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            use.append((i, [math.floor(options.scale * x) for x in v], label))
    out = []
    for i, a, label in use:
        if i is None or not anchors(i):
            continue
        scored = sorted((-max(min(sum(x * y for x, y in zip(a, v)), 2**63 - 1), 1 - 2**63), math.inf if j is None else j, m) for j, v, m in use if j != i)
        for minus, j, m in [s for s in scored if s[2] == label][: options.positives]:
            fit = [s for s in scored if s[2] != label and options.low * -minus <= 100 * -s[0] <= options.high * -minus]
            out += [(i, j, r, s[1], -minus, -s[0]) for r, s in enumerate(fit[: options.negatives], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.anchor_id, r.positive_id, r["rank"], math.inf if r.negative_id is None else r.negative_id, r.positive_score, r.negative_score) for r in df.collect()), key=repr)


def test_strassen():
    rng = np.random.default_rng(1)
    for m, k, n in [(1, 1, 1), (33, 40, 70), (129, 65, 257), (100, 64, 31), (512, 64, 2048), (40, 0, 50)]:
        a, b = rng.integers(-(2**30), 2**30, (m, k)), rng.integers(-(2**30), 2**30, (k, n))
        assert (negatives.strassen(a, b) == a @ b).all()
    big = np.array([[2**70 + i * j for i in range(40)] for j in range(40)], object)
    assert (negatives.strassen(big, big) == big @ big).all()


@pytest.mark.parametrize("blocks", [(1 << 20, (512, 2048)), (40, (3, 7))])
def test_against_plain(spark, monkeypatch, blocks):
    monkeypatch.setattr(negatives, "BLOCK_VALUES", blocks[0])
    monkeypatch.setattr(negatives, "TILE", blocks[1])
    rng = np.random.default_rng(2)
    rows = []
    for i in range(150):
        v = np.round(rng.normal(0, 0.2, 6) + (i % 3) * 0.2, 1).tolist()  # few values: many ties
        rows.append((i, v, 0 if i % 2 else i % 5))  # label 0 has most rows
    rows[3] = (3, None, 1)
    rows[10] = (10, rows[10][1], None)
    rows[20] = (20, [0.1, None, 0.1], 1)
    rows[30] = (30, [0.1, math.nan], 2)
    rows[40] = (40, [math.inf], 2)
    rows[50] = (50, [], 2)  # no components: scores are 0
    rows[55] = (55, [-0.5, 0.25], 2)
    rows.append((None, [0.3] * 6, 3))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, vector array<double>, label int, row string, score int")
    options = negatives.MiningOptions(positives=3, negatives=4)
    want = plain(rows, lambda i: i % 5 == 0, options)
    assert len(want) > 100
    assert got(negatives.mine(df.repartition(3), F.col("vec_id") % 5 == 0, options)) == want


def test_large_components(spark):
    """Scores that no long holds are compared exactly as far as they fit, then as the largest long."""
    rows = [(i, [(-1.0) ** i * 2.0**40 * (i + 1), 1.5 * i, 1e18 if i > 17 else 0.0], i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>, label long")
    assert got(negatives.mine(df, F.col("vec_id") % 4 == 0)) == plain(rows, lambda i: i % 4 == 0)


def test_repeated_and_empty(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.9, 0.0], 2), (1, [0.9, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<float>, label int")
    out = got(negatives.mine(df, F.col("vec_id") == 0))
    # each copy of the anchor has the other for its positive
    assert out == sorted([(0, 0, k, 1, 65536, 58880) for k in (1, 2)] * 2)
    for none in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id = 0")):
        assert negatives.mine(none, F.col("vec_id") == 0).count() == 0


def test_query(spark, data):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{data}/embeddings.parquet'")
    df = queries.op13_hard_negatives(spark, data)
    want = con.sql(queries.ORACLE_SQL["op13_hard_negatives"])
    names = sorted(df.columns)
    assert sorted(want.columns) == names
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(want.select(*names).fetchall())
    assert dict(df.dtypes)["rank"] == "int"

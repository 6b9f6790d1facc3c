"""The nearest rows by streams past chunks, against brute force."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from farfield.operators import analytics
from farfield.operators.nearest import Nearest, meeting, searched, unit, vectors


def test_the_nearest_of_a_stream_are_those_of_brute_force():
    rng = np.random.default_rng(1)
    q, v, y = unit(rng.normal(size=(300, 6))), unit(rng.normal(size=(2000, 6))), rng.integers(0, 5, 2000)
    near = Nearest(q, 9)
    for a, b in ((0, 4), (4, 5), (5, 700), (700, 2000)):
        near.see(v[a:b], y[a:b])
    far = 1 - q @ v.T
    at = np.argsort(far, axis=1)[:, :9]
    assert np.allclose(near.d, np.take_along_axis(far, at, 1)) and (near.y == y[at]).all()


def test_a_task_holds_a_chunk_and_sees_every_row(spark):
    rows = spark.range(3000).selectExpr("id as k", "array(cast(id as double)) as x")

    def begin(asked: pa.Table) -> tuple:
        seen = []
        found = lambda: [pa.RecordBatch.from_arrays([pa.array([asked.num_rows]), pa.array([int(sum(v.sum() for v in seen))])], names=["n", "s"])]
        return lambda b: seen.append(vectors(b, "x")), found

    got = meeting(rows, rows.select("x"), "k", 200).mapInArrow(lambda b: searched(b, begin), "n long, s long").collect()
    assert sum(r["n"] for r in got) == 3000 and len(got) == 15 and max(r["n"] for r in got) < 300
    assert {r["s"] for r in got} == {3000 * 2999 // 2}


def test_screening_without_a_cap_compares_all_rows(spark):
    rng = np.random.default_rng(2)
    x, domain = rng.normal(size=(400, 5)), np.arange(400) % 3
    rows = spark.createDataFrame([(k, int(d), [float(c) for c in v]) for k, (d, v) in enumerate(zip(domain, x, strict=True))], "k long, zone int, x array<double>")
    far = np.where(domain[:, None] == domain, np.inf, np.linalg.norm(x[:, None] - x, axis=2)).min(axis=1)
    got = {r["zone"]: r["mean_nearest"] for r in analytics.screening(rows, "zone", "k", cap=None).collect()}
    assert all(abs(got[d] - far[domain == d].mean()) < 1e-9 for d in range(3)) and len(got) == 3

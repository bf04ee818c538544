import numpy as np

from tagloom.operators import approximate as A


def test_no_item_of_a_probed_cell_is_left_out(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8)], "item_id long, vec array<double>")
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 600, 50)], "request_id long, vec array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    centres = unit[:5]
    order = np.argsort(-np.round(unit @ centres.T, 12), axis=1, kind="stable")
    want = set()
    for q in range(0, 600, 50):
        near = [i for i in range(600) if order[i, 0] in order[q, :2]]
        want |= {(q, i, n + 1) for n, i in enumerate(sorted(near, key=lambda i: (-round(float(unit[q] @ unit[i]), 12), i))[:7])}
    assert {(r.request_id, r.item_id, r["rank"]) for r in A.cell_top_k(asked, items, centres, 7, 2).collect()} == want

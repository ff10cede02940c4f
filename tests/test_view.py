"""The opportunity view: amounts do not depend on the order in which lines arrive."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd

from dealscope.plans import roles


def test_order_sums_are_exact(spark, tmp_path):
    rng = np.random.default_rng(5)
    n, lines = 1500, 4
    price, discount, tax = rng.integers(90_000, 10_000_000, n * lines), rng.integers(0, 11, n * lines), rng.integers(0, 9, n * lines)
    day = pd.Timestamp("1996-01-01")
    tables = {
        "nation": {"n_nationkey": [1], "n_name": ["N"]}, "customer": {"c_custkey": [1], "c_name": ["C"], "c_nationkey": [1], "c_mktsegment": ["M"]},
        "orders": {"o_orderkey": np.arange(n), "o_custkey": 1, "o_orderpriority": "P", "o_orderstatus": "F", "o_orderdate": day, "o_totalprice": 1.0},
        "lineitem": {"l_orderkey": np.repeat(np.arange(n), lines), "l_shipdate": day, "l_quantity": 1.0, "l_extendedprice": price / 100, "l_discount": discount / 100, "l_tax": tax / 100},
    }
    for name, columns in tables.items():
        spark.createDataFrame(pd.DataFrame(columns)).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["code"]: (r["revenue"], r["revenue_updated"]) for r in roles.opportunities(spark, str(tmp_path)).collect()}
    net = (price * (100 - discount)).reshape(n, lines).sum(axis=1)
    gross = (price * (100 - discount) * (100 + tax)).reshape(n, lines).sum(axis=1)
    fourth = lambda units: float((Decimal(int(units)) / 1_000_000).quantize(Decimal("0.0001"), ROUND_HALF_UP))
    assert got == {i: (fourth(net[i] * 100), fourth(gross[i])) for i in range(n)}

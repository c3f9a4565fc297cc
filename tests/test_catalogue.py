"""Every scalar operator of the catalogue compiles and resolves on a panel."""

import datetime as dt

from loomspan.functions.registry import OPS
from loomspan.plans import formula as fm

ARGS = {
    "ts_EXISTR": "close > open, 5, 2", "ts_LAST": "close > open, 5, 2", "ts_SMA_CN": "close, 5, 2", "ts_partial_corr": "close, open, high, 5", "ts_triple_corr": "close, open, high, 5", "cut": "close, 12, 15", "ts_均线多头排列": "close, 2, 5, 10", "ts_均线空头排列": "close, 2, 5, 10",
    **{n: "close, 5, 2" for n in ("ts_mean_hl", "ts_std_hl", "ts_sum_hl", "ts_var_hl")}, **{n: "close, open, 5" for n in ("ts_regression_slope", "ts_regression_intercept", "ts_regression_pred", "ts_regression_resid", "ts_weighted_mean", "ts_weighted_sum")},
    "FROMOPEN": "at", "FROMOPEN_1": "at, 3",
}
COLS = ["open", "high", "low", "close", "volume", "open", "high"]


def call(name, op):
    if name in ARGS:
        return ARGS[name]
    if op.kind == "gp":
        return "ind, close"
    if name.startswith("vec_"):
        return ", ".join(["v", "2"][: op.least])
    if isinstance(op.window, int) and op.window < op.least:
        return ", ".join("5" if i == op.window else "close" for i in range(op.least))
    return ", ".join(COLS[: op.least])


def test_all_resolve(spark):
    row = ("a", dt.date(2024, 1, 1), 1.0, 2.0, 0.5, 1.5, 10.0, "i", [1.0, 2.0, 3.0], dt.datetime(2024, 1, 1, 10, 0))
    df = spark.createDataFrame([row], "code string, date date, open double, high double, low double, close double, volume double, ind string, v array<double>, at timestamp")
    done, bad = 0, []
    for name, op in sorted(OPS.items()):
        if op.kind in ("im", "day") or op.returns == "struct" or name in fm.INTERNAL or name in ("ts_REFX", "fold") or name.startswith(("macd_", "ts_plugin")):
            continue
        try:
            assert fm.compute(df, f"r = {name}({call(name, op)})").dtypes[-1] == ("r", "double")
            done += 1
        except Exception as e:
            bad.append((name, str(e)[:120]))
    assert not bad and done > 350, bad

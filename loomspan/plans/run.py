"""From a factor spec to artefacts, and the command line."""

from __future__ import annotations

import argparse
import importlib.util
import json
import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import registry
from loomspan.operators import evaluate, panel, process
from loomspan.plans import formula
from loomspan.sources import tables


@dataclass
class Spec:
    """name, formula, direction, chain of processors, date range, universe formula, parameters and macros."""

    name: str
    formula: str
    direction: int = 1
    process: Sequence[str] = ()
    start: str | None = None
    end: str | None = None
    universe: str | None = None
    params: Mapping[str, object] = field(default_factory=dict)
    macros: Mapping[str, tuple] = field(default_factory=dict)
    horizon: int = 5
    outputs: Sequence[str] = ()  # of a formula with several; none: its last assignment, as signal

    @classmethod
    def of(cls, d: Mapping[str, object]) -> Spec:
        unknown = set(d) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
        s = cls(**d)
        if s.direction not in (1, -1):
            raise ValueError("direction is 1 or -1")
        return s

    @classmethod
    def load(cls, path: str) -> Spec:
        """From a JSON or, where the parser is installed, a YAML file."""
        with open(path) as h:
            text = h.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            return cls.of(yaml.safe_load(text))
        return cls.of(json.loads(text))


def run_factor(df: DataFrame, spec: Spec, code: str = "code", date: str = "date", price: str = "close") -> DataFrame:
    """Panel -> signal (processed) with its forward label; the date range cuts only at the end, so windows see all history.

    Formula windows and labels use the whole history; the processing chain sees the universe's members only. A spec with outputs
    gives a column for each, processed by the same chain.
    """
    mask = None
    if spec.universe:
        members = formula.pool(df, spec.universe, code=code, date=date)
        df = df.join(members, [code, date])
        mask = F.col("in_universe")
    keep = [c for c in df.columns if c not in (code, date, "signal")]
    s = formula.compute(df, spec.formula, spec.outputs or None, code=code, date=date, mask=mask, params=spec.params, macros=spec.macros, keep=[c for c in keep if c not in spec.outputs])
    if not spec.outputs:
        s = s.withColumnRenamed(s.columns[-1], "signal")
    s = panel.forward_returns(s, F.col(price), (spec.horizon,), code, date)
    if mask is not None:
        s = s.where("in_universe")
    for out in spec.outputs or ("signal",):
        s = process.run_chain(s, spec.process, signal=out, date=date, code=code)
    return tables.between(s, date, spec.start, spec.end)


def evaluate_factor(s: DataFrame, spec: Spec, date: str = "date") -> dict:
    label = f"forward_return_{spec.horizon}d"
    ic = evaluate.ic_series(s, "signal", label, date).cache()
    b = evaluate.bucket_returns(s, "signal", label, 10, date).cache()
    out = evaluate.ic_summary(ic, date=date).first().asDict()
    # one number a date: small by construction
    out["ic_newey_west_t"] = evaluate.newey_west_t([r["rank_ic"] for r in ic.orderBy(date).select("rank_ic").collect()])
    out["spread"] = evaluate.spread(b, 10, spec.direction, date).agg(F.avg("spread")).first()[0]
    out["monotonic"] = evaluate.monotonicity(b).first()[0]
    ic.unpersist()
    b.unpersist()
    return out


def load_plugin(path: str) -> None:
    """Runs a plug-in file that registers operators named ts_... or cs_...; nothing stays registered if it fails."""
    with registry.transaction():
        before = set(registry.OPS)
        spec = importlib.util.spec_from_file_location("loomspan_plugin", path)
        mod = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(mod)
        for n in set(registry.OPS) - before:
            kind = registry.OPS[n].kind
            if kind not in ("ts", "cs") or not n.startswith(kind + "_"):
                raise ValueError(f"plug-in operator {n!r} of kind {kind!r}: names are ts_... or cs_... by kind")


def main(argv: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomspan")
    sub = p.add_subparsers(dest="cmd", required=True)
    one = sub.add_parser("run", help="compute, evaluate and write a factor")
    one.add_argument("spec"), one.add_argument("panel"), one.add_argument("out"), one.add_argument("--plugin", action="append", default=[])
    lint = sub.add_parser("lint", help="check a formula against columns")
    lint.add_argument("formula"), lint.add_argument("--columns", default="")
    ops = sub.add_parser("ops", help="list operators")
    ops.add_argument("--kind")
    show = sub.add_parser("show", help="what an artefact says of itself")
    show.add_argument("folder")
    corr = sub.add_parser("corr", help="correlation of two artefacts")
    corr.add_argument("a"), corr.add_argument("b")
    a = p.parse_args(argv)
    if a.cmd == "ops":
        for n, o in sorted(registry.OPS.items()):
            if not a.kind or o.kind == a.kind:
                print(f"{n}\t{o.kind}\t{o.least}..{o.most or '*'}\t{o.doc.splitlines()[0] if o.doc else ''}")
        return 0
    if a.cmd == "lint":
        try:
            cols = formula.columns_of(a.formula)
        except formula.FormulaError as e:
            print(e, file=sys.stderr)
            return 1
        missing = [c for c in cols if a.columns and c not in a.columns.split(",")]
        print(json.dumps({"columns": cols, "missing": missing}))
        return 1 if missing else 0
    spark = SparkSession.builder.getOrCreate()
    if a.cmd == "show":
        print(json.dumps(tables.read_artifact(spark, a.folder)[1]))
        return 0
    if a.cmd == "corr":
        x, y = (tables.read_artifact(spark, f)[0].select("date", "code", F.col("signal").alias(n)) for f, n in ((a.a, "a"), (a.b, "b")))
        print(json.dumps(evaluate.factor_correlation(x.join(y, ["date", "code"]), ["a", "b"]).first().asDict()))
        return 0
    for f in a.plugin:
        load_plugin(f)
    spec = Spec.load(a.spec)
    s = run_factor(spark.read.parquet(a.panel), spec)
    label = f"forward_return_{spec.horizon}d"
    outs = spec.outputs or ("signal",)
    tables.write_artifact(s.select("date", "code", *outs), a.out, {"name": spec.name, "formula": spec.formula}, {"labels": s.select("date", "code", label), "panel": s.select("date", "code", *outs, label)})
    reports = {o: evaluate_factor(s.withColumn("signal", F.col(o)), spec) for o in outs}
    print(json.dumps(reports if spec.outputs else reports["signal"], default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())

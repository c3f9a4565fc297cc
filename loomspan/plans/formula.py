"""The formula language: Python-syntax text to DataFrame columns.

Text is parsed, gated (allow-listed syntax, reserved names, causality, arity),
functions and macros are inlined, and each assignment becomes a Column over the
panel. Equal sub-expressions are compiled once. Operators of one key share a
window, so a formula costs one exchange per change of key; recursive operators
become stages. No expression is simplified algebraically: that could change
what is null or NaN.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from loomspan.functions import crosssection, elementwise, intraday, technical, timeseries  # noqa: F401  (register)
from loomspan.functions.numeric import INF, NAN, col, dbl, fdiv
from loomspan.functions.recursive import StagedContext, run_stages
from loomspan.functions.registry import ALIASES, OPS, get

ALIASES.update({"ts_cci": "ts_CCI", "sign_": "sign"})


class FormulaError(ValueError):
    """A formula that is not accepted, with the reason."""


ALLOWED = (
    ast.Module, ast.Assign, ast.Expr, ast.Name, ast.Load, ast.Store, ast.Constant, ast.BinOp, ast.UnaryOp, ast.Compare, ast.IfExp, ast.Call, ast.keyword,
    ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Mod, ast.Pow, ast.UAdd, ast.USub, ast.Lt, ast.LtE, ast.Gt, ast.GtE, ast.Eq, ast.NotEq,
    ast.Attribute, ast.Subscript, ast.FunctionDef, ast.arguments, ast.arg, ast.Return, ast.List, ast.Tuple,
)
METHODS = ("abs", "log", "log1p", "sqrt", "exp", "sign", "floor")
# Methods that exist elsewhere and are refused here, by reason.
LOOK_AHEAD = ("backward_fill", "interpolate", "interpolate_by", "reverse")
CALLBACKS = ("map_batches", "map_elements", "pipe", "rolling_map", "cumulative_eval")
CONTEXT = (
    "agg_groups all any append arg_max arg_min arg_sort count drop_nulls drop_nans entropy exclude explode first flatten head implode item kurtosis last len limit max mean median min mode n_unique over product quantile rank repeat_by reshape rolling "
    "sample shuffle skew slice std sum tail top_k unique value_counts var sort sort_by filter gather gather_every get hash hist qcut cut rle rle_id"
).split()
#: columns that hold the future, and names the engine keeps to itself
UNREADABLE = re.compile(r"^(forward_|future_)|^(target|label)$")
RESERVED = re.compile(r"^__|^in_universe$")
MACROS = {
    "returns": (("close",), "close / ts_delay(close, 1) - 1"),
    "adv20": (("v",), "ts_mean(v, 20)"),
    "vwap": (("h", "l", "c", "v"), "ts_cum_sum((h + l + c) / 3 * v) / ts_cum_sum(v)"),
}
INTERNAL = {"cs_mean"}


def substitute(text: str, params: Mapping[str, object] | None) -> str:
    """${name} by its value; unknown names are an error."""

    def one(m: re.Match) -> str:
        if params is None or m[1] not in params:
            raise FormulaError(f"parameter ${{{m[1]}}} has no value")
        return str(params[m[1]])

    return re.sub(r"\$\{(\w+)\}", one, text)


def gate(tree: ast.AST) -> None:
    """Refuses everything outside the allow-list."""
    for n in ast.walk(tree):
        if isinstance(n, (ast.BoolOp, ast.Not)):
            raise FormulaError("and / or / not are ambiguous on columns; use and_, or_, not_")
        if not isinstance(n, ALLOWED):
            raise FormulaError(f"{type(n).__name__} is not allowed in a formula")
        if isinstance(n, ast.Constant) and not (n.value is None or isinstance(n.value, (bool, int, float, str))):
            raise FormulaError(f"constant {n.value!r} is not allowed")
        if isinstance(n, ast.Assign) and (len(n.targets) != 1 or not isinstance(n.targets[0], ast.Name)):
            raise FormulaError("an assignment binds one plain name")
        if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store) and (RESERVED.search(n.id) or UNREADABLE.search(n.id)):
            raise FormulaError(f"{n.id!r} cannot be bound")


def columns_of(text: str, params: Mapping[str, object] | None = None) -> list[str]:
    """Columns a formula reads, in order of first use."""
    tree = parse(text, params)
    bound: set[str] = set()
    seen: dict[str, None] = {}
    for st in tree.body:
        if isinstance(st, ast.FunctionDef):
            bound.add(st.name)
            continue
        args = {id(c.func) for c in ast.walk(st) if isinstance(c, ast.Call)}
        for n in ast.walk(st.value):
            if isinstance(n, ast.Name) and n.id not in bound and id(n) not in args:
                seen.setdefault(n.id)
        if isinstance(st, ast.Assign):
            bound.add(st.targets[0].id)
    return list(seen)


def parse(text: str, params: Mapping[str, object] | None = None) -> ast.Module:
    try:
        tree = ast.parse(substitute(text, params).strip() + "\n")
    except SyntaxError as e:
        raise FormulaError(f"no formula: {e}") from e
    if not tree.body:
        raise FormulaError("empty formula")
    gate(tree)
    return tree


class _Compiler:
    def __init__(self, ctx: StagedContext, columns: Sequence[str], macros: Mapping[str, tuple] | None = None):
        self.ctx, self.columns, self.env = ctx, set(columns), {}
        self.defs: dict[str, tuple[list[str], list, ast.expr]] = {}
        self.memo: dict[str, object] = {}
        self.depth = 0
        for name, (ps, body) in {**MACROS, **(macros or {})}.items():
            self.defs[name] = (list(ps), [], ast.parse(body, mode="eval").body)

    # -- helpers
    def fold(self, v):
        return v

    def number(self, v, what: str) -> float:
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            raise FormulaError(f"{what} must be a number known when the formula is compiled")
        return v

    def expr(self, n: ast.expr, local: dict | None = None):
        key = ast.dump(n) if not local else None
        if key is not None and key in self.memo:
            return self.memo[key]
        v = self._expr(n, local or {})
        if key is not None:
            self.memo[key] = v
        return v

    def _expr(self, n: ast.expr, local: dict):
        if isinstance(n, ast.Constant):
            return n.value
        if isinstance(n, (ast.List, ast.Tuple)):
            return [self.expr(e, local) for e in n.elts]
        if isinstance(n, ast.Name):
            return self.name(n.id, local)
        if isinstance(n, ast.UnaryOp):
            v = self.expr(n.operand, local)
            return -v if isinstance(n.op, ast.USub) else v
        if isinstance(n, ast.BinOp):
            return self.binary(n, local)
        if isinstance(n, ast.Compare):
            left, out = self.expr(n.left, local), None
            for op, r in zip(n.ops, n.comparators, strict=True):
                right = self.expr(r, local)
                a, b = col(left), col(right)
                one = {ast.Lt: lambda: a < b, ast.LtE: lambda: a <= b, ast.Gt: lambda: a > b, ast.GtE: lambda: a >= b, ast.Eq: lambda: a == b, ast.NotEq: lambda: a != b}[type(op)]()
                out = one if out is None else out & one
                left = right
            return out
        if isinstance(n, ast.IfExp):
            return F.when(col(self.expr(n.test, local)).cast("boolean"), col(self.expr(n.body, local))).otherwise(col(self.expr(n.orelse, local)))
        if isinstance(n, ast.Subscript):
            k = self.expr(n.slice, local)
            return self.call("ts_delay", [self.expr(n.value, local), self.number(k, "a subscript")], {})
        if isinstance(n, ast.Call):
            kw = {k.arg: self.expr(k.value, local) for k in n.keywords}
            if isinstance(n.func, ast.Attribute):
                if n.func.attr in LOOK_AHEAD:
                    raise FormulaError(f"method .{n.func.attr}() looks ahead")
                if n.func.attr in CALLBACKS:
                    raise FormulaError(f"method .{n.func.attr}() calls opaque Python; register a plug-in operator instead")
                if n.func.attr in CONTEXT:
                    raise FormulaError(f"method .{n.func.attr}() depends on grouping or order; use a ts_, cs_ or gp_ operator")
                if n.func.attr not in METHODS:
                    raise FormulaError(f"method .{n.func.attr}() is not allowed; methods are {', '.join(METHODS)}")
                return self.call(n.func.attr, [self.expr(n.func.value, local), *[self.expr(a, local) for a in n.args]], kw)
            if not isinstance(n.func, ast.Name):
                raise FormulaError("only named operators can be called")
            args = [self.expr(a, local) for a in n.args]
            if n.func.id in self.defs:
                return self.inline(n.func.id, args, kw)
            return self.call(n.func.id, args, kw)
        raise FormulaError(f"{type(n).__name__} is not allowed here")

    def name(self, name: str, local: dict):
        if name in local:
            return local[name]
        if name in self.env:
            return self.env[name]
        if UNREADABLE.search(name) or RESERVED.search(name):
            raise FormulaError(f"column {name!r} cannot be read by a formula")
        if name == "has_trade" and name not in self.columns and "amount" in self.columns:
            return F.col("amount") > 0
        if name not in self.columns:
            import difflib

            near = difflib.get_close_matches(name, sorted(self.columns), 3)
            raise FormulaError(f"no column {name!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))
        return F.col(name)

    def binary(self, n: ast.BinOp, local: dict):
        a, b = self.expr(n.left, local), self.expr(n.right, local)
        both = not isinstance(a, Column) and not isinstance(b, Column)
        if isinstance(n.op, ast.Add):
            return a + b if both else col(a) + col(b)
        if isinstance(n.op, ast.Sub):
            return a - b if both else col(a) - col(b)
        if isinstance(n.op, ast.Mult):
            return a * b if both else col(a) * col(b)
        if isinstance(n.op, ast.Div):
            if both:
                return a / b if b else (NAN if not a else (INF if a > 0 else -INF))
            return fdiv(a, b)
        if isinstance(n.op, ast.Mod):
            return a % b if both and b else OPS["mod"].fn(self.ctx, a, b)
        return a**b if both else F.pow(dbl(a), dbl(b))

    def inline(self, name: str, args: list, kw: dict):
        ps, defaults, body = self.defs[name]
        if self.depth > 20:
            raise FormulaError(f"{name} is recursive")
        if len(args) > len(ps):
            raise FormulaError(f"{name} takes {len(ps)} arguments")
        bound = dict(zip(ps, args, strict=False))
        for k, v in kw.items():
            if k not in ps or k in bound:
                raise FormulaError(f"{name}: argument {k!r}")
            bound[k] = v
        for p, d in zip(ps[len(ps) - len(defaults):], defaults, strict=True):
            bound.setdefault(p, d)
        missing = [p for p in ps if p not in bound]
        if missing:
            raise FormulaError(f"{name}: {', '.join(missing)} missing")
        self.depth += 1
        try:
            return self.expr(body, bound)
        finally:
            self.depth -= 1

    def call(self, name: str, args: list, kw: dict):
        try:
            op = get(name)
        except KeyError as e:
            raise FormulaError(e.args[0]) from e
        if name in INTERNAL:
            raise FormulaError(f"{name} is internal")
        n = len(args) + len(kw)
        if n < op.least or op.most is not None and n > op.most and not kw:
            raise FormulaError(f"{name} takes {op.least}{'' if op.most == op.least else '..' + str(op.most or '*')} arguments, not {n}")
        if op.kind in ("im", "day") and self.ctx.minute is None:
            raise FormulaError(f"{name} needs an intraday grid")
        if name == "ts_REFX":
            raise FormulaError("ts_REFX looks ahead")
        if op.kind == "ts" and isinstance(op.window, int) and len(args) > op.window:
            w = args[op.window]
            if isinstance(w, Column):
                raise FormulaError(f"{name}: the window must be a number")
            if w is not None and (isinstance(w, bool) or w != int(w) or w < 0):
                raise FormulaError(f"{name}: a window of {w} looks ahead or is none")
            if w == 0 and name not in ("ts_delay", "ts_REF", "ts_delta", "ts_DIFF", "ROUND2"):
                raise FormulaError(f"{name}: a window of 0 holds nothing")
        if op.kind == "im" and len(args) > 1 and (isinstance(args[1], Column) or int(args[1]) < 1):
            raise FormulaError(f"{name}: the window must be a positive number")
        if op.masked and self.ctx.mask is not None:
            args = [F.when(self.ctx.mask, col(a)) if i in op.masked and isinstance(a, Column) else a for i, a in enumerate(args)]
        if op.kind == "el":
            args = [a if isinstance(a, Column) or i >= 1 or not isinstance(a, (int, float)) else F.lit(float(a)) for i, a in enumerate(args)]
        try:
            return op.fn(self.ctx, *args, **kw)
        except TypeError as e:
            raise FormulaError(f"{name}: {e}") from e

    def run(self, tree: ast.Module) -> dict[str, object]:
        out: dict[str, object] = {}
        for st in tree.body:
            if isinstance(st, ast.FunctionDef):
                self.define(st)
            elif isinstance(st, ast.Assign):
                v = self.expr(st.value)
                self.env[st.targets[0].id] = out[st.targets[0].id] = v
                self.memo.clear()
            else:
                out["signal"] = self.expr(st.value)
        return out

    def define(self, f: ast.FunctionDef) -> None:
        if len(f.body) != 1 or not isinstance(f.body[0], ast.Return) or f.decorator_list or f.args.kwonlyargs or f.args.vararg or f.args.kwarg:
            raise FormulaError(f"def {f.name}: only positional parameters and a single return")
        if any(isinstance(n, ast.Name) and n.id == f.name for n in ast.walk(f.body[0])):
            raise FormulaError(f"{f.name} is recursive")
        self.defs[f.name] = ([a.arg for a in f.args.args], [self.expr(d) for d in f.args.defaults], f.body[0].value)


def compute(
    df: DataFrame,
    formula: str,
    outputs: Sequence[str] | None = None,
    *,
    code: str = "code",
    date: str = "date",
    minute: str | None = None,
    mask: Column | None = None,
    params: Mapping[str, object] | None = None,
    macros: Mapping[str, tuple] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The panel (code, date, [minute]) with the formula's outputs: by default its last assignment.

    mask: universe membership; data arguments of cross-sectional operators
    outside of it are null, while time series see the whole history. Rows stay as they
    are, unsorted. Day operators give the day's value on each of its rows; `daily_fold` reduces those.
    """
    ctx = StagedContext(code, date, minute, mask)
    c = _Compiler(ctx, df.columns, macros)
    got = c.run(parse(formula, params))
    names = list(outputs or list(got)[-1:])
    for n in names:
        if n not in got:
            raise FormulaError(f"output {n!r} is not assigned")
    df = run_stages(df, ctx)
    for n, t in df.select([col(got[n]).alias(n) for n in names]).dtypes:
        if t.startswith(("struct", "array", "map")):
            raise FormulaError(f"output {n!r} is a {t.split('<')[0]}; take one of its fields with a plug-in operator")
    keys = [code, date, *([minute] if minute else []), *keep]
    return df.select(*[F.col(k) for k in keys], *[_double(got[n]).alias(n) for n in names])


def _double(v: object) -> Column:
    v = col(v)
    return v.cast("double")


def pool(df: DataFrame, formula: str, base: Column | None = None, **keys) -> DataFrame:
    """Membership by a boolean formula over the whole panel, and-ed with `base`: (code, date, in_universe)."""
    out = compute(df, formula, **keys, keep=())
    name = out.columns[-1]
    member = F.coalesce(F.col(name) != 0, F.lit(False))
    out = out.withColumn("in_universe", member).drop(name)
    if base is None:
        return out
    k = [keys.get("code", "code"), keys.get("date", "date")]
    return out.join(df.select(*k, base.alias("_base")), k).withColumn("in_universe", F.col("in_universe") & F.coalesce("_base", F.lit(False))).drop("_base")


class _NoFold(Exception):
    pass


class FoldContext(StagedContext):
    """Collects day aggregates instead of computing them on every row."""

    def day_value(self, agg, x: Column) -> Column:
        if "__day" in str(x):
            raise _NoFold
        folds = self.__dict__.setdefault("folds", {})
        name = f"__day{len(folds)}__"
        folds[name] = (agg, x)
        return F.col(name)


def daily_fold(df: DataFrame, formula: str, outputs: Sequence[str] | None = None, *, code: str = "code", date: str = "date", minute: str = "minute_index", **kw) -> DataFrame:
    """A formula over the intraday grid whose outputs are one value a day: (code, date, outputs), one row a day.

    Where the outputs are made of day aggregates alone, one aggregation with map-side combination computes all of them. Where a
    day value is used on the grid again, or across rows, the value on the day's last minute is taken.
    """
    try:
        if kw.get("mask") is not None or kw.get("keep"):
            raise _NoFold
        ctx = FoldContext(code, date, minute)
        c = _Compiler(ctx, df.columns, kw.get("macros"))
        got = c.run(parse(formula, kw.get("params")))
        names = list(outputs or list(got)[-1:])
        folds = ctx.__dict__.get("folds")
        if not folds or any(n not in got or "OVER (" in str(got[n]) or "windowspec" in str(got[n]).lower() for n in names):
            raise _NoFold
        grid = run_stages(df, ctx).select(code, date, minute, *[x.alias(f"{n}in") for n, (_, x) in folds.items()])
        day = grid.groupBy(code, date).agg(*[agg(F.col(f"{n}in"), F.col(minute)).alias(n) for n, (agg, _) in folds.items()])
        return day.select(code, date, *[_double(got[n]).alias(n) for n in names])
    except (_NoFold, AnalysisException):  # an output that also reads the grid is not resolved by the days
        pass
    wide = compute(df, formula, outputs, code=code, date=date, minute=minute, **kw)
    names = [c for c in wide.columns if c not in (code, date, minute)]
    return wide.groupBy(code, date).agg(*[F.max_by(n, F.col(minute)).alias(n) for n in names])

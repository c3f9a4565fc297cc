"""The operator registry of the formula language."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KINDS = ("el", "ts", "cs", "gp", "ta", "im", "day")


@dataclass
class Context:
    """Keys of the panel a formula runs on, and the windows made of them."""

    code: str = "code"
    date: str = "date"
    minute: str | None = None
    mask: Column | None = None  # universe membership, applied to data arguments of cs and gp operators

    @property
    def ts(self) -> WindowSpec:
        return Window.partitionBy(self.code).orderBy(self.date)

    def hold(self, c: Column) -> Column:
        """c, where a context can compute it once for all of its uses."""
        return c

    @property
    def cs(self) -> list[Column]:
        return [F.col(self.date)]

    @property
    def day(self) -> list[str]:
        return [self.code, self.date]

    def day_value(self, agg: Callable[[Column, Column], Column], x: Column) -> Column:
        """An aggregate of x over the rows of its entity and day, on each of them; agg: (x, minute) -> aggregate."""
        return agg(x, F.col(self.minute)).over(Window.partitionBy(*self.day))

    @property
    def im(self) -> WindowSpec:
        return Window.partitionBy(self.code, self.date).orderBy(self.minute)


@dataclass
class Op:
    """name, kind, fn(ctx, *args) -> Column; args arrive as Columns or Python numbers.

    window: position of the window argument, an int as string for a fixed one, "unbounded" or None.
    masked: positions of data arguments that the universe mask applies to. returns: scalar or struct.
    sequential: fn is instead a numpy kernel fn(arrays, params) run once per entity over sorted batches.
    """

    name: str
    kind: str
    fn: Callable
    least: int = 1
    most: int | None = None
    window: int | str | None = None
    masked: tuple[int, ...] = ()
    returns: str = "scalar"
    sequential: bool = False
    doc: str = ""
    params: tuple = field(default_factory=tuple)


OPS: dict[str, Op] = {}
ALIASES: dict[str, str] = {}


def factor_op(name: str, kind: str, least: int = 1, most: int | None = -1, window: int | str | None = None, masked: tuple[int, ...] = (), returns: str = "scalar", aliases: tuple[str, ...] = (), sequential: bool = False) -> Callable:
    """Registers an operator. most=-1: as many as least; None: any number."""
    if kind not in KINDS:
        raise ValueError(f"kind {kind!r} is none of {KINDS}")

    def add(fn: Callable) -> Callable:
        for n in (name, *aliases):
            if n in OPS:
                raise ValueError(f"operator {n!r} is registered already")
        op = Op(name, kind, fn, least, least if most == -1 else most, window, masked, returns, sequential, (fn.__doc__ or "").strip())
        for n in (name, *aliases):
            OPS[n] = op
        return fn

    return add


def get(name: str) -> Op:
    name = ALIASES.get(name, name)
    if name not in OPS:
        import difflib

        near = difflib.get_close_matches(name, OPS, 3)
        raise KeyError(f"unknown operator {name!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))
    return OPS[name]


class transaction:
    """Operators registered inside are dropped again if the block fails."""

    def __enter__(self):
        self.saved, self.alias = dict(OPS), dict(ALIASES)
        return self

    def __exit__(self, kind, *_):
        if kind is not None:
            OPS.clear()
            OPS.update(self.saved)
            ALIASES.clear()
            ALIASES.update(self.alias)
        return False

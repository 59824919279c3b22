"""A small algebra of panel expressions and a planner that turns them into few Spark stages.

Formulas are written over the columns of a dense panel (one row per session and
ticker).  Operators over time look back from the current session inside one
ticker, operators over the cross-section look at all tickers of one session.
Expressions are interned, so a sub-expression that many features share exists
once.  The planner sorts window expressions by depth and by kind; all windows
of one depth and kind go into one projection.  Windows over time keep the
partitioning and order of the panel, so only a change between time and
cross-section costs a shuffle.  Ranks of a depth are one Arrow pass by session:
as SQL windows each of them would sort the panel anew, all in one task.

The planner emits SQL expressions; the same plan can be emitted for DuckDB as
a chain of common table expressions, which the correctness checks run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

TIME, CROSS, FRAME = "time", "cross", "frame"
ORDERED = {"crank", "crow"}
EPS = 1e-12


def min_obs(w: int) -> int:
    """Observations that a window of w sessions must hold."""
    return max(2, math.ceil(0.8 * w))


class Expr:
    """An interned node: operator and arguments (nodes or constants)."""

    _known: dict[tuple, Expr] = {}
    __slots__ = ("op", "args", "depth", "name")

    def __new__(cls, op: str, *args):
        key = (op, *[("e", id(a)) if isinstance(a, Expr) else ("c", type(a).__name__, a) for a in args])
        if key not in cls._known:
            self = super().__new__(cls)
            self.op, self.args = op, args
            below = max((a.depth for a in args if isinstance(a, Expr)), default=0)
            self.depth = below + (op in WINDOWS)
            self.name = f"x{len(cls._known)}"
            cls._known[key] = self
        return cls._known[key]

    def __add__(self, o):
        return Expr("+", self, wrap(o))

    def __radd__(self, o):
        return Expr("+", wrap(o), self)

    def __sub__(self, o):
        return Expr("-", self, wrap(o))

    def __rsub__(self, o):
        return Expr("-", wrap(o), self)

    def __mul__(self, o):
        return Expr("*", self, wrap(o))

    def __rmul__(self, o):
        return Expr("*", wrap(o), self)

    def __truediv__(self, o):
        return Expr("/", self, wrap(o))

    def __rtruediv__(self, o):
        return Expr("/", wrap(o), self)

    def __neg__(self):
        return Expr("*", wrap(-1.0), self)

    def __pow__(self, k: int):
        return reduce(lambda a, _: a * self, range(k - 1), self)

    def __lt__(self, o):
        return Expr("<", self, wrap(o))

    def __le__(self, o):
        return Expr("<=", self, wrap(o))

    def __gt__(self, o):
        return Expr(">", self, wrap(o))

    def __ge__(self, o):
        return Expr(">=", self, wrap(o))

    def __and__(self, o):
        return Expr("AND", self, o)

    def __or__(self, o):
        return Expr("OR", self, o)


def wrap(x) -> Expr:
    return x if isinstance(x, Expr) else Expr("lit", float(x))


#: Operators that need a window, and the side on which they look.
WINDOWS = dict.fromkeys("lag lead last cumsum cumcount cummax runstart fmean fstd fcount".split(), TIME)
#: Over time, of a frame that slides.  Spark makes each frame anew, value by value; NumPy takes all frames of a ticker at once,
#: in one Arrow pass for all operators of a depth, some twenty times as fast.
WINDOWS |= dict.fromkeys("wcount wmean wsum wstd wmin wmax wskew wkurt wcov sincemax sincemin wquant rankpast fpath".split(), FRAME)
WINDOWS |= dict.fromkeys("crank ccount cmean gmean csum gsum crow grow pick".split(), CROSS)


def _masked_pair(x: Expr, y: Expr) -> tuple[Expr, Expr]:
    return where(present(y), x), where(present(x), y)


# -- row-wise operators -------------------------------------------------------------------------------------------
def col(name: str) -> Expr:
    return Expr("col", name)


def present(x: Expr) -> Expr:
    return Expr("notnull", x)


def where(cond: Expr, x, otherwise=None) -> Expr:
    """x where cond is true; elsewhere (also where cond is unknown) otherwise, or missing."""
    return Expr("if", cond, wrap(x)) if otherwise is None else Expr("if", cond, wrap(x), wrap(otherwise))


def flag(cond: Expr, of: Expr | None = None) -> Expr:
    """1 where cond is true, 0 where it is not or is unknown; missing where ``of`` is."""
    f = where(cond, 1.0, 0.0)
    return f if of is None else where(present(of), f)


def sdiv(a, b) -> Expr:
    """a / b, missing where b is (almost) zero."""
    return Expr("sdiv", wrap(a), wrap(b))


def log(x: Expr) -> Expr:
    return Expr("log", x)


def sqrt(x: Expr) -> Expr:
    return Expr("sqrt", x)


def exp(x: Expr) -> Expr:
    return Expr("exp", x)


def mag(x: Expr) -> Expr:
    return Expr("abs", x)


def sign(x: Expr) -> Expr:
    return Expr("sign", x)


def floor(x: Expr) -> Expr:
    return Expr("floor", x)


def ceil(x: Expr) -> Expr:
    return Expr("ceil", x)


def hi2(a, b) -> Expr:
    """The larger of two; missing if either is."""
    a, b = wrap(a), wrap(b)
    return where(present(a) & present(b), Expr("greatest", a, b))


def lo2(a, b) -> Expr:
    a, b = wrap(a), wrap(b)
    return where(present(a) & present(b), Expr("least", a, b))


def pos(x: Expr) -> Expr:
    return hi2(x, 0.0)


def neg(x: Expr) -> Expr:
    return lo2(x, 0.0)


def clip(x: Expr, lo: float, hi: float) -> Expr:
    return lo2(hi2(x, lo), hi)


def largest(*xs: Expr) -> Expr:
    """The largest of those that are present."""
    return Expr("greatest", *xs)


def smallest(*xs: Expr) -> Expr:
    return Expr("least", *xs)


def first_of(*xs) -> Expr:
    return Expr("coalesce", *[wrap(x) for x in xs])


# -- operators over time ------------------------------------------------------------------------------------------
def lag(x: Expr, k: int) -> Expr:
    return Expr("lag", x, k) if k else x


def lead(x: Expr, k: int) -> Expr:
    return Expr("lead", x, k) if k else x


def _gated(op: str, x: Expr, w: int, m: int | None, *more) -> Expr:
    return where(Expr("wcount", x, w) >= (min_obs(w) if m is None else m), Expr(op, x, w, *more))


def mean(x: Expr, w: int, m: int | None = None) -> Expr:
    return _gated("wmean", x, w, m)


def total(x: Expr, w: int, m: int | None = None) -> Expr:
    return _gated("wsum", x, w, m)


def std(x: Expr, w: int, m: int | None = None) -> Expr:
    return _gated("wstd", x, w, m)


def low_of(x: Expr, w: int, m: int | None = None) -> Expr:
    return _gated("wmin", x, w, m)


def high_of(x: Expr, w: int, m: int | None = None) -> Expr:
    return _gated("wmax", x, w, m)


def skew(x: Expr, w: int) -> Expr:
    return _gated("wskew", x, w, None)


def kurt(x: Expr, w: int) -> Expr:
    return _gated("wkurt", x, w, None)


def quantile(x: Expr, w: int, q: float) -> Expr:
    return _gated("wquant", x, w, None, q)


def zscore(x: Expr, w: int, m: int | None = None) -> Expr:
    return sdiv(x - mean(x, w, m), std(x, w, m))


def cov(x: Expr, y: Expr, w: int, m: int | None = None) -> Expr:
    a, b = _masked_pair(x, y)
    return where(Expr("wcount", a, w) >= (min_obs(w) if m is None else m), Expr("wcov", a, b, w))


def beta(x: Expr, y: Expr, w: int, m: int | None = None) -> Expr:
    b = where(present(x), y)
    return sdiv(cov(x, y, w, m), cov(b, b, w, m))


def corr(x: Expr, y: Expr, w: int) -> Expr:
    a, b = _masked_pair(x, y)
    return sdiv(cov(x, y, w), sqrt(cov(a, a, w) * cov(b, b, w)))


def slope(x: Expr, w: int) -> Expr:
    """Least-squares slope on the session number, over the present values."""
    t = where(present(x), col("session_idx"))
    return sdiv(cov(x, t, w), cov(t, t, w))


def rank_past(x: Expr, w: int, m: int) -> Expr:
    """Mid-rank share of x among the present values of the w sessions before.

    Computed values count as equal if they agree to ten decimals: a window's sum that slides is not the sum made anew.
    """
    return Expr("rankpast", x if x.op == "col" else Expr("snug", x), w, m)


def since_high(x: Expr, w: int) -> Expr:
    """Sessions since the (latest) maximum of the window, as a share of w."""
    return Expr("sincemax", x, w)


def since_low(x: Expr, w: int) -> Expr:
    return Expr("sincemin", x, w)


def run(cond: Expr) -> Expr:
    """Consecutive sessions up to now on which cond is true."""
    return col("session_idx") - first_of(Expr("runstart", cond), -1.0)


def fill(x: Expr, limit: int) -> Expr:
    """The last present value, at most ``limit`` sessions old."""
    return Expr("last", x, limit)


def running(x: Expr) -> Expr:
    """Sum from the first session on, missing counted as zero."""
    return Expr("cumsum", first_of(x, 0.0))


def history(x: Expr) -> Expr:
    """Present values so far."""
    return Expr("cumcount", x)


# -- operators over the cross-section ------------------------------------------------------------------------------
TRADABLE = col("tradable")


def rank(x: Expr, mask: Expr = TRADABLE) -> Expr:
    """Average rank in [0, 1] among the tickers that mask lets in; missing for one ticker alone."""
    y = where(mask, x)
    n = Expr("ccount", y)
    return where(present(y), sdiv(Expr("crank", y) - 1.0, where(n > 1.0, n - 1.0)))


def cross_mean(x: Expr, mask: Expr = TRADABLE) -> Expr:
    return Expr("cmean", where(mask, x))


def group_mean(x: Expr, mask: Expr = TRADABLE) -> Expr:
    return Expr("gmean", where(mask, x))


def of_ticker(x: Expr, ticker: str) -> Expr:
    """The value that one ticker has in the session."""
    return Expr("pick", x, ticker)


def position(x: Expr) -> Expr:
    """Ordinal position (from 1) in the session; ties in the order of tickers, missing last."""
    return Expr("crow", x)


def is_ticker(name: str) -> Expr:
    return Expr("named", name)


def first_of_group() -> Expr:
    """True at one ticker of each group and session, the first by name."""
    return Expr("grow", col("session_idx")) <= 1.0


def cross_count(x: Expr) -> Expr:
    return Expr("ccount", x)


def cross_sum(x: Expr) -> Expr:
    return Expr("csum", x)


def group_sum(x: Expr) -> Expr:
    return Expr("gsum", x)


def ahead(op: str, x: Expr, a: int, b: int) -> Expr:
    """mean, std or count over the sessions a..b after the current one."""
    return Expr(f"f{op}", x, a, b)


def worst_fall(x: Expr, a: int, b: int) -> Expr:
    """Lowest x / (running peak) - 1 over the sessions a..b ahead, all of which must be present."""
    return Expr("fpath", x, a, b)


# -- planning ------------------------------------------------------------------------------------------------------
class Emitter:
    """SQL text of expressions; windows that a former stage computed are columns."""

    def __init__(self, dialect: str):
        self.spark = dialect == "spark"
        self.done: dict[Expr, str] = {}

    def text(self, e: Expr) -> str:
        if e in self.done:
            return self.done[e]
        op, a = e.op, e.args
        t = lambda i: self.text(a[i])
        if op == "col":
            return a[0]
        if op == "named":
            return f"(ticker = '{a[0]}')"
        if op == "lit":
            return f"CAST({a[0]!r} AS DOUBLE)"
        if op in "+-*" or op in ("<", "<=", ">", ">=", "AND", "OR"):
            return f"({t(0)} {op} {t(1)})"
        if op == "/":
            return f"try_divide({t(0)}, {t(1)})" if self.spark else f"({t(0)} / nullif({t(1)}, 0))"
        if op == "sdiv":
            return f"(CASE WHEN abs({t(1)}) > {EPS} THEN {t(0)} / {t(1)} END)"
        if op == "NOT":
            return f"(NOT {t(0)})"
        if op == "notnull":
            return f"({t(0)} IS NOT NULL)"
        if op == "if":
            return f"(CASE WHEN {t(0)} THEN {t(1)}{f' ELSE {t(2)}' if len(a) > 2 else ''} END)"
        if op == "log":
            return f"(CASE WHEN {t(0)} > 0 THEN ln({t(0)}) END)"
        if op == "sqrt":
            return f"(CASE WHEN {t(0)} >= 0 THEN sqrt({t(0)}) END)"
        if op in ("floor", "ceil"):
            return f"CAST({op}({t(0)}) AS DOUBLE)"
        if op == "snug":
            return f"(CAST(floor({t(0)} * 1e10 + 0.5) AS DOUBLE) / 1e10)"
        if op == "sign":
            return f"CAST(sign({t(0)}) AS DOUBLE)"
        if op in ("abs", "exp", "greatest", "least", "coalesce", "sin", "cos"):
            return f"{op}({', '.join(self.text(x) for x in a)})"
        return self.window(e)

    def window(self, e: Expr) -> str:
        op, a = e.op, e.args
        x = self.text(a[0])
        by_time = "PARTITION BY ticker ORDER BY session_idx"
        if op in ("lag", "lead"):
            return f"{op}({x}, {a[1]}) OVER ({by_time})"
        trailing = f"OVER ({by_time} ROWS BETWEEN {a[1] - 1} PRECEDING AND CURRENT ROW)" if len(a) > 1 and isinstance(a[1], int) else ""
        simple = {"wcount": "count", "wmean": "avg", "wsum": "sum", "wstd": "stddev_samp", "wmin": "min", "wmax": "max"}
        if op in simple:
            return f"{simple[op]}({x}) {trailing}"
        if op == "wcov":
            return f"covar_samp({x}, {self.text(a[1])}) OVER ({by_time} ROWS BETWEEN {a[2] - 1} PRECEDING AND CURRENT ROW)"
        n = f"count({x}) {trailing}"
        if op in ("wskew", "wkurt"):
            return f"{dict(wskew='skewness', wkurt='kurtosis')[op]}({x}) {trailing}"
        if op == "wquant":
            return f"quantile_cont({x}, {a[2]}) {trailing}"
        if op == "rankpast":
            lst = f"list({x}) FILTER ({x} IS NOT NULL) OVER ({by_time} ROWS BETWEEN {a[1]} PRECEDING AND 1 PRECEDING)"
            less = lambda s: f"len(list_filter({lst}, lambda u: u {s} {x}))"
            return f"(CASE WHEN {x} IS NOT NULL AND len({lst}) >= {a[2]} THEN ({less('<')} + 0.5 * {less('=')}) / len({lst}) END)"
        if op in ("sincemax", "sincemin"):
            v = x if op == "sincemax" else f"(-1 * {x})"
            at = f"(max(CASE WHEN {x} IS NOT NULL THEN struct_pack(v := {v}, i := session_idx) END) {trailing}).i"
            return f"(CASE WHEN session_idx >= {a[1] - 1} AND {n} >= {0.8 * a[1]} THEN CAST(session_idx - {at} AS DOUBLE) / {a[1]} END)"
        so_far = f"OVER ({by_time} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        if op == "last":
            w = f"OVER ({by_time} ROWS BETWEEN {a[1]} PRECEDING AND CURRENT ROW)"
            return f"last_value({x}, true) {w}" if self.spark else f"last_value({x} IGNORE NULLS) {w}"
        if op in ("cumsum", "cumcount", "cummax"):
            return f"{dict(cumsum='sum', cumcount='count', cummax='max')[op]}({x}) {so_far}"
        if op == "runstart":
            return f"max(CASE WHEN {x} THEN NULL ELSE session_idx END) {so_far}"
        if op in ("fmean", "fstd", "fcount"):
            ahead = f"OVER ({by_time} ROWS BETWEEN {a[1]} FOLLOWING AND {a[2]} FOLLOWING)"
            return f"{dict(fmean='avg', fstd='stddev_samp', fcount='count')[op]}({x}) {ahead}"
        if op == "fpath":  # worst fall from the running peak over the next sessions a[1]..a[2], all of which must be present
            ahead = f"OVER ({by_time} ROWS BETWEEN {a[1]} FOLLOWING AND {a[2]} FOLLOWING)"
            many = a[2] - a[1] + 1
            lst = f"list({x}) FILTER ({x} IS NOT NULL) {ahead}"
            worst = f"list_min(list_transform({lst}, lambda v, i: v / list_max(({lst})[1:i]) - 1))"
            return f"(CASE WHEN len({lst}) = {many} THEN least({worst}, 0) END)"
        cross = "PARTITION BY session_idx"
        if op == "crank":
            return f"(rank() OVER ({cross} ORDER BY {x} ASC NULLS LAST) + (count({x}) OVER ({cross}, {x}) - 1) / CAST(2 AS DOUBLE))"
        if op in ("ccount", "cmean", "csum"):
            return f"{dict(ccount='count', cmean='avg', csum='sum')[op]}({x}) OVER ({cross})"
        if op in ("gmean", "gsum"):
            return f"{dict(gmean='avg', gsum='sum')[op]}({x}) OVER ({cross}, asset_group)"
        if op == "crow":
            return f"row_number() OVER ({cross} ORDER BY {x} ASC NULLS LAST, ticker)"
        if op == "grow":
            return f"row_number() OVER ({cross}, asset_group ORDER BY ticker)"
        if op == "pick":
            return f"max(CASE WHEN ticker = '{a[1]}' THEN {x} END) OVER ({cross})"
        raise ValueError(f"unknown operator {op}")


def rounded(text: str, digits: int | None) -> str:
    """Rounding by plain arithmetic: engines differ in how round() treats halves."""
    return text if digits is None else f"(CAST(floor(CAST({text} AS DOUBLE) * 1e{digits} + 0.5) AS DOUBLE) / 1e{digits})"


def stages(outputs: dict[str, Expr]) -> list[list[Expr]]:
    """The window nodes, in the order in which they can be computed, those of one depth and kind together."""
    found: dict[Expr, None] = {}

    def walk(e: Expr) -> None:
        if e in found:
            return
        for a in e.args:
            if isinstance(a, Expr):
                walk(a)
        if e.op in WINDOWS:
            found[e] = None

    for e in outputs.values():
        walk(e)
    plan = []
    for depth in range(1, max((e.depth for e in found), default=0) + 1):
        for kind in (TIME, FRAME, CROSS):
            if some := [e for e in found if e.depth == depth and WINDOWS[e.op] == kind]:
                plan.append(some)
    return plan


def _frames(x: np.ndarray, first: int, last: int) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows, their frames) of the sessions first..last around each, missing beyond the ends; some rows at a time."""
    padded = np.concatenate([np.full(max(0, -first), np.nan), x, np.full(max(0, last), np.nan)])
    view = np.lib.stride_tricks.sliding_window_view(padded[max(0, first) :], last - first + 1)
    for a in range(0, len(x), 4096):
        yield slice(a, min(a + 4096, len(x))), view[a : min(a + 4096, len(x))]


def _moments(op: str, frame: np.ndarray, other: np.ndarray | None) -> np.ndarray:
    known = ~np.isnan(frame)
    n = known.sum(axis=1)
    if op == "wcount":
        return n.astype(float)
    if op in ("wmin", "wmax"):
        pick, none = (np.min, np.inf) if op == "wmin" else (np.max, -np.inf)
        return np.where(n > 0, pick(np.where(known, frame, none), axis=1), np.nan)
    total = np.where(known, frame, 0.0).sum(axis=1)
    if op == "wsum":
        return np.where(n > 0, total, np.nan)
    if op == "wmean":
        return np.where(n > 0, total / n, np.nan)
    off = np.where(known, frame - (total / n)[:, None], 0.0)
    if op == "wcov":
        theirs = np.where(known, other, 0.0)
        return np.where(n > 1, (off * (theirs - (theirs.sum(axis=1) / n)[:, None])).sum(axis=1) / (n - 1), np.nan)
    square = (off**2).sum(axis=1)
    if op == "wstd":
        return np.where(n > 1, np.sqrt(square / (n - 1)), np.nan)
    if op == "wskew":  # with the correction for small samples
        return np.where(n > 2, (off**3).sum(axis=1) / n / (square / n) ** 1.5 * np.sqrt(n * (n - 1.0)) / (n - 2), np.nan)
    flat = (off**4).sum(axis=1) / n / (square / n) ** 2 - 3
    return np.where(n > 3, ((n + 1) * flat + 6) * (n - 1) / ((n - 2.0) * (n - 3)), np.nan)


def frame_values(op: str, x: np.ndarray, *args, other: np.ndarray | None = None, first: int = 0) -> np.ndarray:
    """The values of one frame operator over a ticker's sessions (from session ``first`` on), NaN for missing."""
    out = np.full(len(x), np.nan)
    with np.errstate(invalid="ignore", divide="ignore"):
        if op == "rankpast":
            w, least = args
            for rows, frame in _frames(x, -w, -1):
                v, n = x[rows], (~np.isnan(frame)).sum(axis=1)
                share = ((frame < v[:, None]).sum(axis=1) + 0.5 * (frame == v[:, None]).sum(axis=1)) / n
                out[rows] = np.where(np.isnan(v) | (n < max(least, 1)), np.nan, share)
        elif op == "wquant":
            w, q = args
            for rows, frame in _frames(x, 1 - w, 0):
                n = (~np.isnan(frame)).sum(axis=1)
                at = q * np.maximum(n - 1, 0)
                lo = np.floor(at).astype(np.int64)
                each, ordered = np.arange(len(frame)), np.sort(frame, axis=1)
                below, above = ordered[each, lo], ordered[each, np.minimum(lo + 1, np.maximum(n - 1, 0))]
                out[rows] = np.where(n > 0, below + (above - below) * (at - lo), np.nan)
        elif op in ("sincemax", "sincemin"):
            (w,) = args
            for rows, frame in _frames(x if op == "sincemax" else -x, 1 - w, 0):
                known = ~np.isnan(frame)
                ago = np.where(known, frame, -np.inf)[:, ::-1].argmax(axis=1)  # of equal ones the latest
                session = first + np.arange(rows.start, rows.stop)
                out[rows] = np.where((session >= w - 1) & (known.sum(axis=1) >= 0.8 * w), ago / w, np.nan)
        elif op == "fpath":
            a, b = args
            for rows, frame in _frames(x, a, b):
                peak = np.maximum.accumulate(np.maximum(frame, 0), axis=1)
                out[rows] = np.where(np.isnan(frame).any(axis=1), np.nan, np.minimum((frame / peak - 1).min(axis=1), 0))
        else:
            (w,) = args
            theirs = _frames(other, 1 - w, 0) if other is not None else None
            for rows, frame in _frames(x, 1 - w, 0):
                out[rows] = _moments(op, frame, next(theirs)[1] if theirs else None)
    return out


def _frame_stage(df: DataFrame, group: list[Expr], emit: Emitter) -> DataFrame:
    """The panel with the values of frame operators, one Arrow pass; a group is one ticker's sessions."""
    given: dict[str, str] = {}
    todo = []
    for e in group:
        inputs = [given.setdefault(emit.text(a), f"in_{len(given)}") for a in e.args if isinstance(a, Expr)]
        todo.append((e.name, e.op, inputs, tuple(a for a in e.args if not isinstance(a, Expr))))
    names = df.columns

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("session_idx")
        values = {c: table.column(c).to_numpy().astype(float) for c in given.values()}
        first = table.column("session_idx")[0].as_py() if table.num_rows else 0
        out = table.select(names)
        for name, op, inputs, args in todo:
            v = frame_values(op, values[inputs[0]], *args, other=values[inputs[1]] if len(inputs) > 1 else None, first=first)
            out = out.append_column(name, pa.array(v, pa.float64(), mask=np.isnan(v)))
        return out

    schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n, *_ in todo]])
    return df.selectExpr("*", *[f"CAST({text} AS DOUBLE) AS {c}" for text, c in given.items()]).groupBy("ticker").applyInArrow(one, schema)


def session_values(op: str, session: np.ndarray, x: pa.ChunkedArray, ticker: np.ndarray) -> np.ndarray:
    """crank, crow or ccount of whole sessions, as the SQL windows have them: missing last, NaN a value above all others.

    session: ascending numbers; ticker: places of the tickers in their order.
    """
    null = x.is_null().to_numpy()
    each = np.arange(len(session))
    begins = np.flatnonzero(np.diff(session, prepend=session[:1] - 1))
    counts = np.diff(np.append(begins, len(session)))
    known = np.repeat(np.add.reduceat(~null, begins, dtype=np.int64), counts)
    if op == "ccount":
        return known
    v = x.fill_null(0.0).to_numpy()
    order = np.lexsort((ticker, v, null, session) if op == "crow" else (v, null, session))
    out = np.empty(len(session), np.int32 if op == "crow" else float)
    place = each - np.repeat(begins, counts)
    if op == "crow":
        out[order] = place + 1
        return out
    v, none = v[order], null[order]
    tied = (session[1:] == session[:-1]) & (none[1:] == none[:-1]) & ((v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1])))
    first = np.flatnonzero(np.append(True, ~tied))
    many = np.diff(np.append(first, len(session)))
    out[order] = np.repeat(place[first] + 1 + (np.where(none[first], 0, many) - 1) / 2, many)
    return out


def _ordered_stage(df: DataFrame, group: list[Expr], emit: Emitter) -> DataFrame:
    """The panel with ranks and counts of the cross-section: one shuffle and one sort by session, however many they are.

    A task holds a batch and the session that is not yet whole.
    """
    given: dict[str, str] = {}
    todo = [(e.name, e.op, given.setdefault(emit.text(e.args[0]), f"in_{len(given)}")) for e in group]
    names = df.columns
    kinds = {"crank": (DoubleType(), pa.float64()), "crow": (IntegerType(), pa.int32()), "ccount": (LongType(), pa.int64())}

    def places(column) -> np.ndarray:
        return pc.rank(column, null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)

    def whole(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        session, ticker = places(table.column("session_idx")), places(table.column("ticker"))
        out = table.select(names)
        for name, op, c in todo:
            out = out.append_column(name, pa.array(session_values(op, session, table.column(c), ticker), kinds[op][1]))
        yield from out.combine_chunks().to_batches()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None  # of the session that is not yet whole
        for batch in batches:
            if not batch.num_rows:
                continue
            session = batch.column(at)
            begin = int(np.searchsorted(numbers := places(session), numbers[-1]))
            if begin or held and session[0].as_py() != now:
                yield from whole([*held, batch.slice(0, begin)])
                held = []
            held.append(batch.slice(begin))
            now = session[-1].as_py()
        if held:
            yield from whole(held)

    at = names.index("session_idx")
    schema = StructType([*df.schema.fields, *[StructField(n, kinds[op][0]) for n, op, _ in todo]])
    sent = df.selectExpr("*", *[f"CAST({text} AS DOUBLE) AS {c}" for text, c in given.items()])
    return sent.repartition("session_idx").sortWithinPartitions("session_idx").mapInArrow(of, schema)


def _shared(outputs: dict[str, Expr]) -> list[Expr]:
    """Row-wise expressions of some size that several others read, those below first."""
    readers: dict[Expr, int] = {}
    order: list[Expr] = []

    def walk(e: Expr) -> None:
        readers[e] = readers.get(e, 0) + 1
        if readers[e] == 1:
            for a in e.args:
                if isinstance(a, Expr):
                    walk(a)
            order.append(e)

    for e in outputs.values():
        walk(e)
    return [e for e in order if readers[e] > 1 and e.op not in WINDOWS and e.op not in ("col", "lit", "notnull") and e.args]


def _named(df: DataFrame, shared: list[Expr], emit: Emitter) -> DataFrame:
    """The panel with a column for each shared expression whose windows are there; one projection for each level of them."""

    def ready(e: Expr) -> bool:
        return e in emit.done or e.op not in WINDOWS and all(ready(a) for a in e.args if isinstance(a, Expr))

    def level(e: Expr) -> int:
        below = max((level(a) for a in e.args if isinstance(a, Expr)), default=0) if e not in emit.done else 0
        return below + (e in todo)

    todo = [e for e in shared if e not in emit.done and ready(e)]
    todo = dict.fromkeys(todo)
    levels: dict[int, list[Expr]] = {}
    for e in todo:
        levels.setdefault(level(e), []).append(e)
    for k in sorted(levels):
        df = df.selectExpr("*", *[f"{emit.text(e)} AS {e.name}" for e in levels[k]])
        emit.done |= {e: e.name for e in levels[k]}
    return df


def evaluate(panel: DataFrame, outputs: dict[str, Expr], keep: tuple[str, ...] = ("date", "ticker"), digits: int | None = None) -> DataFrame:
    """The panel's ``keep`` columns with the outputs."""
    emit = Emitter("spark")
    df = panel
    shared = _shared(outputs)
    for group in stages(outputs):
        df = _named(df, shared, emit)
        ordered = [e for e in group if e.op in ORDERED]
        ordered += [e for e in group if ordered and e.op == "ccount"]
        if WINDOWS[group[0].op] == FRAME:
            df = _frame_stage(df, group, emit)
        elif rest := [e for e in group if e not in ordered]:
            df = df.selectExpr("*", *[f"{emit.text(e)} AS {e.name}" for e in rest])
        if ordered:
            df = _ordered_stage(df, ordered, emit)
        emit.done |= {e: e.name for e in group}
    df = _named(df, shared, emit)
    last = {n: rounded(emit.text(e), digits) for n, e in outputs.items()}
    return df.selectExpr(*keep, *[f"{t} AS {n}" for n, t in last.items()])


def to_sql(base: str, outputs: dict[str, Expr], keep: tuple[str, ...] = ("date", "ticker"), digits: int | None = None) -> str:
    """The same for DuckDB: ``base`` is a list of CTEs, the last of which is named panel."""
    emit = Emitter("duckdb")
    ctes, source = [base], "panel"
    for k, group in enumerate(stages(outputs)):
        ctes.append(f"s{k} AS (SELECT *, " + ", ".join(f"{emit.text(e)} AS {e.name}" for e in group) + f" FROM {source})")
        emit.done |= {e: e.name for e in group}
        source = f"s{k}"
    last = {n: rounded(emit.text(e), digits) for n, e in outputs.items()}
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {', '.join(keep)}, " + ", ".join(f"{t} AS {n}" for n, t in last.items()) + f" FROM {source}"

"""Wilkinson formulas over Spark DataFrames.

Grammar: ``lhs ~ rhs``; terms joined by ``+`` and ``-``, crossed by ``*``, nested by ``/``
(``a / b`` is ``a + a:b``), interacted by ``:``, and ``(a + b) ** n`` (or ``^``) for all
interactions of up to n of them; ``.`` for every column that the left side does not use; ``0``,
``1`` and ``-1`` for the intercept; parentheses; factors are names (backticks allowed), calls, or
``{expression}``.  Expressions are read with Python's own parser and turned into Columns by
:mod:`expressions`; formula text is never evaluated.

Terms are ordered by degree.  With ``ensure_full_rank``, a term is expanded into its
scoped parts (each categorical reduced or absent), parts spanned by earlier terms are
left out, and the rest is merged again where a full coding spans the same space.
"""

from __future__ import annotations

import ast
import itertools
import json
import math
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.matrix import DesignMatrix
from ..plans.catalog import SPARSE, Block, Categorical, Numeric
from ..plans.spread import TASK_ROWS
from .expressions import BUILT_IN, Compiler, Flag, StructureError, flag
from .levels import LevelTable, clean, level_table, observe, resolve, with_code
from .quantiles import percentiles

# -- parsing -------------------------------------------------------------------


def tokens(text: str) -> list[str]:
    """Operators, numbers, and whole factors (names with their calls, quoted names, braces)."""
    out, i = [], 0

    def closing(at: int) -> int:
        depth, quote = 0, ""
        for k in range(at, len(text)):
            c = text[k]
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"":
                quote = c
            elif c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
                if not depth:
                    return k
        raise ValueError(f"unbalanced brackets in {text!r}")

    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
        elif text.startswith("**", i):
            out.append("**")
            i += 2
        elif c in "+-*/^:~()":
            out.append("**" if c == "^" else c)
            i += 1
        elif c == "{":
            end = closing(i)
            out.append(text[i + 1 : end].strip())
            i = end + 1
        elif c == "`":
            end = text.index("`", i + 1)
            out.append(text[i : end + 1])
            i = end + 1
        elif c.isalnum() or c in "_.":
            j = i
            while j < len(text) and (text[j].isalnum() or text[j] in "_."):
                j += 1
            if j < len(text) and text[j] == "(":
                j = closing(j) + 1
            out.append(text[i:j])
            i = j
        else:
            raise ValueError(f"unsupported operator {c!r} in formula {text!r}")
    return out


def sides(text: str) -> tuple[str, str, str]:
    """Left side, tilde, right side; a tilde inside of brackets is no separator."""
    depth, quote, at = 0, "", -1
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "~" and not depth:
            at = k
    return ("", "", text) if at < 0 else (text[:at], "~", text[at + 1 :])


Term = tuple[str, ...]


def parse_terms(text: str, intercept: bool, others: Sequence[str] = ()) -> list[Term]:
    """Terms in order of degree; the empty tuple is the intercept.  ``others`` is what ``.`` stands for."""
    items = tokens(text)
    at = 0

    def peek() -> str | None:
        return items[at] if at < len(items) else None

    def atom() -> list[Term]:
        nonlocal at
        t = peek()
        at += 1
        if t == "(":
            inner = expression()
            if peek() != ")":
                raise ValueError(f"missing ) in {text!r}")
            at += 1
            return inner
        if t == ".":
            return [(c if c.isidentifier() else f"`{c}`",) for c in others]
        if t is None or t in ("+", "-", "*", "/", ":", "~", ")", "**"):
            raise ValueError(f"unexpected {t!r} in formula {text!r}")
        return [()] if t == "1" else [("0",)] if t == "0" else [(t,)]

    def crossed(a: list[Term], b: list[Term]) -> list[Term]:
        return list(dict.fromkeys(tuple(dict.fromkeys(x + y)) for x in a for y in b))

    def power() -> list[Term]:
        nonlocal at
        base = atom()
        while peek() == "**":
            n = items[at + 1] if at + 1 < len(items) else ""
            if not n.isdigit() or int(n) < 1:
                raise ValueError(f"terms can be raised to a whole number from 1 only, not to {n!r}")
            at += 2
            picks = [tuple(dict.fromkeys(f for t in pick for f in t)) for k in range(1, int(n) + 1) for pick in itertools.combinations(base, k)]
            base = list({frozenset(t): t for t in reversed(picks)}.values())[::-1]
        return base

    def interaction() -> list[Term]:
        nonlocal at
        left = power()
        while peek() == ":":
            at += 1
            left = crossed(left, power())
        return left

    def product() -> list[Term]:
        nonlocal at
        left = interaction()
        while peek() in ("*", "/"):
            nested, at = items[at] == "/", at + 1
            right = interaction()
            within = [tuple(dict.fromkeys(f for t in left for f in t))] if nested else left
            left = list(dict.fromkeys([*left, *([] if nested else right), *crossed(within, right)]))
        return left

    def expression() -> list[Term]:
        nonlocal at
        found: dict[Term, None] = {}
        sign = "+"
        if peek() in ("+", "-"):
            sign, at = items[at], at + 1
        while True:
            for term in product():
                remove = (sign == "-") != (term == ("0",))
                key = () if term == ("0",) else term
                if remove:
                    found.pop(key, None)
                    if key == ():
                        dropped.append(True)
                else:
                    found[key] = None
            if peek() not in ("+", "-"):
                return list(found)
            sign, at = items[at], at + 1

    dropped: list[bool] = []
    found = expression() if items else []
    if at != len(items):
        raise ValueError(f"cannot read {items[at]!r} in formula {text!r}")
    if intercept and not dropped and () not in found:
        found = [(), *found]
    return sorted(found, key=len)


# -- factors -------------------------------------------------------------------


@dataclass(frozen=True)
class Coded:
    """A categorical factor: levels with the code of each row."""

    code: Column
    levels: Sequence
    spans_intercept: bool = True


class Names(Sequence):
    """Names of many columns, made when asked for: a factor's levels in a format, or products of two lists."""

    def __init__(self, size: int, one: Callable[[int], str], every: Callable[[], Iterator[str]]):
        self.size, self.one, self.every = size, one, every

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, k):
        return list(self.every())[k] if isinstance(k, slice) else self.one(range(self.size)[k])

    def __iter__(self) -> Iterator[str]:
        return self.every()


def _level_names(levels: Sequence, first: int, made: Callable[[object], str]) -> Sequence[str]:
    if not isinstance(levels, LevelTable):
        return [made(x) for x in levels[first:]]
    return Names(len(levels) - first, lambda k: made(levels[k + first]), lambda: map(made, itertools.islice(iter(levels), first, None)))


def _product_names(a: Sequence[str], b: Sequence[str], sep: str) -> Sequence[str]:
    made = lambda x, y: f"{x}{sep}{y}" if x else y
    if not isinstance(a, Names) and not isinstance(b, Names):
        return [made(x, y) for y in b for x in a]
    return Names(len(a) * len(b), lambda k: made(a[k % len(a)], b[k // len(a)]), lambda: (made(x, y) for y in b for x in a))


@dataclass
class Spec:
    """What a formula learned from its data, for replay on other rows."""

    formula: str
    options: dict
    state: dict = field(default_factory=dict)
    names: list[str] | None = None
    #: (term, names of its columns) in order; what a replay is held against.
    structure: list | None = None
    context: Mapping[str, object] = field(default_factory=dict)
    #: The columns that ``.`` stood for.
    others: list[str] | None = None

    def get_model_matrix(self, df: DataFrame, row_id: str | None = None) -> DesignMatrix:
        return _build(df, replace(self, state=dict(self.state)), row_id)

    def to_json(self, folder: str | None = None) -> str:
        """The spec as text, without ``context``; long lists of levels are written as tables to ``folder``."""
        state = {}
        for key, known in self.state.items():
            if isinstance(known, dict) and isinstance(known.get("levels"), LevelTable):
                if folder is None:
                    raise ValueError(f"{key} has {len(known['levels'])} levels; a folder is needed for them")
                path = f"{folder.rstrip('/')}/levels-{uuid.uuid4().hex}"
                known["levels"].df.write.parquet(path)
                known = known | {"levels": {"table": path, "known": known["levels"].known, "extra": list(known["levels"].extra)}}
            state[key] = known
        return json.dumps({"formula": self.formula, "options": self.options, "state": state, "names": self.names, "structure": self.structure, "others": self.others})

    @classmethod
    def from_json(cls, spark: SparkSession, text: str, context: Mapping[str, object] | None = None) -> "Spec":
        """The spec that ``to_json`` wrote."""
        read = json.loads(text)
        for known in read["state"].values():
            if isinstance(known, dict) and isinstance(known.get("levels"), dict):
                levels = known["levels"]
                known["levels"] = LevelTable(spark.read.parquet(levels["table"]), levels["known"], tuple(levels["extra"]))
        return cls(**read, context=dict(context or {}))


def stateful_transform(function: Callable) -> Callable:
    """Marks a function of ``context`` that learns from its data: it also gets ``state`` and ``df``.

    ``state`` is a dict, empty at first, that the spec keeps for replay; what the function puts
    in it (from aggregates over ``df``) is there again on other rows.
    """
    function.is_stateful = True
    return function


class _Factors:
    """Evaluates factors of one formula over one DataFrame, learning state where it is missing."""

    def __init__(self, df: DataFrame, spec: Spec):
        self.df, self.given, self.spec = df, df, spec
        self.types = {f.name: f.dataType for f in df.schema}
        self.cache: dict[str, Column | Coded | list[tuple[str, Column]]] = {}

    def column(self, name: str) -> Column:
        if name not in self.types:
            raise ValueError(f"no column {name!r}")
        kind = self.types[name]
        c = clean(self.df, name)
        if isinstance(kind, T.BooleanType):
            return flag(c)
        return c.cast("double") if isinstance(kind, (T.NumericType, T.BooleanType)) else c

    def evaluate(self, node: ast.AST):
        """The value of an expression: a Column, a number, text, or a list."""
        return Compiler(self.named, self.called).value(node)

    def named(self, name: str):
        return self.column(name) if name in self.types or name not in self.spec.context else self.spec.context[name]

    def called(self, node: ast.Call, name: str | None, args: Callable[[], list], named: Callable[[], dict]):
        """Functions that learn, and those of the context; NotImplemented for others."""
        if name in ("center", "poly", "bs"):
            return getattr(self, f"_{name}")(ast.unparse(node), *args(), **named())
        own = self.spec.context.get(name) if name else None
        if name in BUILT_IN or not callable(own):
            return NotImplemented
        more = {"state": self.spec.state.setdefault(ast.unparse(node), {}), "df": self.df} if getattr(own, "is_stateful", False) else {}
        return own(*args(), **named(), **more)

    def _center(self, key: str, x: Column) -> Column:
        if key not in self.spec.state:
            self.spec.state[key] = float(self.df.agg(F.avg(x)).first()[0] or 0.0)
        return x - F.lit(self.spec.state[key])

    def _poly(self, key: str, x: Column, degree: int = 1, raw: bool = False) -> list[tuple[str, Column]]:
        if raw:
            return [(str(k), F.pow(x, F.lit(float(k)))) for k in range(1, degree + 1)]
        if key not in self.spec.state:
            # moments of the centred variable give the three-term recurrence of orthogonal polynomials
            n, mean = self.df.agg(F.count(x), F.avg(x)).first()
            c = x - F.lit(float(mean))
            moments = np.array([n, *[float(v) for v in self.df.agg(*[F.sum(F.pow(c, F.lit(float(k)))) for k in range(1, 2 * degree + 2)]).first()]])
            self.spec.state[key] = {"mean": float(mean), "polys": _orthonormal(moments, degree)}
        s = self.spec.state[key]
        c = x - F.lit(s["mean"])
        return [(str(k), reduce(lambda acc, a: acc * c + F.lit(a), s["polys"][k][::-1], F.lit(0.0))) for k in range(1, degree + 1)]

    def _bs(self, key: str, x: Column, df: int = 4, degree: int = 3) -> list[tuple[str, Column]]:
        if key not in self.spec.state:
            inner = max(0, df - degree)
            at = [k / (inner + 1) for k in range(1, inner + 1)]
            low, high, knots = percentiles(self.df, x, at)
            self.spec.state[key] = [float(low)] * (degree + 1) + [float(k) for k in knots] + [float(high)] * (degree + 1)
        t = self.spec.state[key]
        top = max(k for k in range(len(t) - 1) if t[k] < t[k + 1])
        basis = [F.when((x >= t[k]) & ((x <= t[k + 1]) if k == top else (x < t[k + 1])), 1.0).otherwise(0.0) if t[k] < t[k + 1] else F.lit(0.0) for k in range(len(t) - 1)]
        for d in range(1, degree + 1):
            nxt = []
            for k in range(len(t) - 1 - d):
                left = (x - t[k]) / (t[k + d] - t[k]) * basis[k] if t[k + d] > t[k] else F.lit(0.0)
                right = (t[k + d + 1] - x) / (t[k + d + 1] - t[k + 1]) * basis[k + 1] if t[k + d + 1] > t[k + 1] else F.lit(0.0)
                nxt.append(left + right)
            basis = nxt
        # rows that a replay finds outside of the knots have no basis
        outside = (x < t[0]) | (x > t[-1])
        checked = lambda b: F.when(outside, F.raise_error(F.lit(f"{key}: values outside of [{t[0]}, {t[-1]}]")).cast("double")).otherwise(b)
        return [(str(k), checked(b)) for k, b in enumerate(basis[1:], 1)]  # without an intercept's column

    def get(self, factor: str):
        """A Column, a list of named Columns, or a Coded."""
        if factor not in self.cache:
            self.cache[factor] = self._get(factor)
        return self.cache[factor]

    def _get(self, factor: str):
        if factor.startswith("`"):
            name, options = factor.strip("`"), {}
            node: ast.AST = ast.Name(name)
        else:
            node = ast.parse(factor, mode="eval").body
            options = {}
        forced = isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "C"
        if forced:
            options = {k.arg: self.evaluate(k.value) for k in node.keywords}
            node = node.args[0]
        value = self.evaluate(node)
        if isinstance(value, Flag):
            value = value.column
        if isinstance(value, (int, float)):
            return F.lit(float(value))
        if isinstance(value, list):
            return value
        kind = self.df.select(value.alias("v")).schema["v"].dataType
        if isinstance(kind, (T.NumericType, T.BooleanType)) and not forced:
            return value.cast("double")
        if isinstance(node, ast.Name) and node.id in self.types:
            raw = self.types[node.id]
            if isinstance(raw, (T.IntegralType, T.BooleanType)):
                value = clean(self.df, node.id)
        return self._coded(factor, value.cast("string") if isinstance(kind, T.NumericType) else value, **options)

    def _coded(self, factor: str, value: Column, levels: Sequence | None = None, missing_method: str | None = None, missing_name: str | None = None, spans_intercept: bool = True) -> Coded:
        o, known = self.spec.options, self.spec.state.get(factor)
        method, missing_name = missing_method or o["cat_missing_method"], missing_name or o["cat_missing_name"]
        name = f"_f{len(self.cache)}_{abs(hash(factor)) % 10**6}"
        frame = self.df.select(value.alias(name))
        if known is None:
            seen, missing = observe(frame, [name], {name: levels})[name]
            found, last = resolve(factor, seen, missing, levels, method, missing_name)
        else:
            found, last = known["levels"], known["missing_last"]
            found = found if isinstance(found, LevelTable) else tuple(found)
            unseen, missing = observe(frame, [name], {name: found if isinstance(found, LevelTable) or not last else found[:-1]})[name]
            if unseen or (missing and method == "convert" and not last):
                raise ValueError(f"column {factor} contains unseen categories")
            if missing and method == "fail":
                raise ValueError(f"Categorical data in {factor} can't have missing values")
        self.spec.state[factor] = {"levels": found if isinstance(found, LevelTable) else list(found), "missing_last": last}
        self.df, code = with_code(self.df, value, found, last, name)
        return Coded(code, found, spans_intercept)


def _orthonormal(moments: np.ndarray, degree: int) -> list[list[float]]:
    """Coefficients, lowest power first, of polynomials orthonormal under the moments."""
    gram = np.array([[moments[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
    out: list[np.ndarray] = []
    for k in range(degree + 1):
        v = np.zeros(degree + 1)
        v[k] = 1.0
        for u in out:
            v = v - (u @ gram @ v) * u
        out.append(v / np.sqrt(v @ gram @ v))
    return [list(map(float, v)) for v in out]


# -- full rank -----------------------------------------------------------------

Scoped = frozenset  # of (factor, reduced)


def scoped_terms(terms: list[Term], spans: Callable[[str], bool | None], full_rank: bool) -> list[list[tuple[tuple[str, bool], ...]]]:
    """For each term its scoped parts: factors in written order, each with "reduced".

    ``spans`` tells of a factor: True for a categorical that spans the intercept, False
    for one that does not, None for a numeric one.
    """
    if not full_rank:
        return [[tuple((f, False) for f in t)] for t in terms]
    spanned: set[frozenset] = set()
    out = []
    for t in terms:
        choices = [[(f, True), None] if spans(f) else [(f, False)] for f in t]
        parts = [frozenset(x for x in pick if x) for pick in itertools.product(*choices)]
        parts = sorted(dict.fromkeys(parts), key=lambda p: (len(p), [t.index(f) for f in t if any(g == f for g, _ in p)]))
        fresh = [p for p in parts if p not in spanned]
        spanned.update(parts)
        merged = True
        while merged:
            merged = False
            for small, big in itertools.permutations(fresh, 2):
                extra = big - small
                if small < big and len(extra) == 1 and next(iter(extra))[1]:
                    (f, _), = extra
                    fresh[fresh.index(big)] = small | {(f, False)}
                    fresh.remove(small)
                    merged = True
                    break
        out.append([tuple((f, r) for f in t for g, r in sorted(p) if g == f) for p in fresh])
    return out


# -- building ------------------------------------------------------------------


def _piece(factors: _Factors, part: tuple[tuple[str, bool], ...], options: dict) -> list[Block]:
    """The product of a scoped part's factors as blocks."""
    sep, form = options["interaction_separator"], options["categorical_format"]
    if options.get("interactions") == "observed" and sum(isinstance(factors.get(f), Coded) for f, _ in part) > 1:
        return _observed_piece(factors, part, options)
    # names: one per level; code: of the level, None while all factors are numeric; value: the numeric product
    items: list[dict] = [{"names": [""], "code": None, "value": None}]
    for factor, reduced in part:
        got = factors.get(factor)
        label = factor.strip("`")
        options_here: list[dict]
        if isinstance(got, Coded):
            first = 1 if reduced else 0
            code = F.when(got.code >= first, got.code - first) if first else got.code
            options_here = [{"names": _level_names(got.levels, first, lambda x, label=label: form.format(name=label, category=x)), "code": code, "value": None}]
        elif isinstance(got, list):
            options_here = [{"names": [f"{label}[{k}]"], "code": None, "value": v} for k, v in got]
        else:
            options_here = [{"names": [label], "code": None, "value": got}]
        # earlier factors vary fastest, among columns and among levels
        items = [_joined(a, b, sep) for b in options_here for a in items]
    term = sep.join(f.strip("`") for f, _ in part)
    out: list[Block] = []
    for x in items:
        if x["code"] is None:
            out.append(Numeric(x["value"].cast("double"), x["names"][0], term))
        elif len(x["names"]):
            names = x["names"] if isinstance(x["names"], Names) else tuple(x["names"])
            out.append(Categorical(x["code"], names, term, term, False, x["value"], "{category}", names))
    return out


def _observed_piece(factors: _Factors, part: tuple[tuple[str, bool], ...], options: dict) -> list[Block]:
    """A scoped part with two categoricals or more, with a column only for combinations of levels that training had.

    They are ordered as in the full product, earlier factors varying fastest, and kept in the
    spec as a table; on other rows a combination without a column is zero.
    """
    sep, form = options["interaction_separator"], options["categorical_format"]
    coded = [(f.strip("`"), factors.get(f), int(reduced)) for f, reduced in part if isinstance(factors.get(f), Coded)]
    codes = [F.when(c.code >= first, c.code) for _, c, first in coded]
    whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in codes])
    value = F.when(whole, F.struct(*[c.cast("int").alias(f"c{k}") for k, c in reversed(list(enumerate(codes)))]))
    key = "combinations of " + sep.join(f"{f}{'-' * first}" for f, _, first in coded)
    if key not in factors.spec.state:
        about = math.prod(len(c.levels) for _, c, _ in coded)
        about = min(about, factors.given.count()) if about > TASK_ROWS else about
        factors.spec.state[key] = {"levels": level_table(factors.df.select(value.alias("_combination")), "_combination", wide=True, about=about), "missing_last": False}
    table: LevelTable = factors.spec.state[key]["levels"]
    label = lambda level: sep.join(form.format(name=f, category=c.levels[level[f"c{k}"]]) for k, (f, c, _) in enumerate(coded))

    def every() -> Iterator[str]:
        lists = [[form.format(name=f, category=x) for x in c.levels] for f, c, _ in coded]
        yield from (sep.join(names[level[f"c{k}"]] for k, names in enumerate(lists)) for level in table)

    names = Names(len(table), lambda k: label(table[k]), every)
    mark = f"_combination_{len(factors.spec.state)}_{len(factors.df.columns)}"
    factors.df = factors.df.join(table.df.toDF("_level", mark), value == F.col("_level"), "left").drop("_level")
    others = [factors.get(f) for f, _ in part if not isinstance(factors.get(f), Coded)]
    labels = [f.strip("`") for f, _ in part if not isinstance(factors.get(f), Coded)]
    lists = [x if isinstance(x, list) else [("", x)] for x in others]
    out: list[Block] = []
    for pick in itertools.product(*lists[::-1]):
        number = reduce(lambda a, b: a * b, [v for _, v in pick[::-1]]) if pick else None
        suffix = sep.join(f"{n}[{k}]" if k else n for n, (k, _) in zip(labels, pick[::-1]))
        own = names if not suffix else Names(len(table), lambda k, t=suffix: f"{names[k]}{sep}{t}", lambda t=suffix: (f"{n}{sep}{t}" for n in names))
        term = sep.join(f.strip("`") for f, _ in part)
        out.append(Categorical(F.col(mark), table, term, term, False, number, "{category}", own, value))
    return out


def _joined(a: dict, b: dict, sep: str) -> dict:
    names = _product_names(a["names"], b["names"], sep)
    value = b["value"] if a["value"] is None else a["value"] if b["value"] is None else a["value"] * b["value"]
    if a["code"] is None or b["code"] is None:
        return {"names": names, "code": b["code"] if a["code"] is None else a["code"], "value": value}
    if len(names) >= 2**31:
        raise OverflowError(f"an interaction of {len(names)} columns; interactions='observed' makes those that occur")
    return {"names": names, "code": b["code"] * F.lit(len(a["names"])) + a["code"], "value": value}


def _build(df: DataFrame, spec: Spec, row_id: str | None) -> DesignMatrix:
    o = spec.options
    terms = parse_terms(spec.formula, o["include_intercept"], spec.others if spec.others is not None else df.columns)
    used = list(dict.fromkeys(f for t in terms for f in t))
    if o["na_action"] != "ignore":
        names = {n.id for f in used for n in ast.walk(ast.parse(f.strip("`") if f.startswith("`") else f, mode="eval")) if isinstance(n, ast.Name) and n.id in df.columns}
        whole = reduce(lambda a, b: a & b, [clean(df, c).isNotNull() for c in sorted(names)], F.lit(True))
        if o["na_action"] == "raise" and df.filter(~whole).limit(1).count():
            raise ValueError("missing values in the data")
        df = df.filter(whole)
    factors = _Factors(df, spec)
    kinds = {f: factors.get(f) for f in used}
    coded_rows = factors.df  # with the codes of factors; those of combinations are joined to it, which sums do not need
    spans = lambda f: kinds[f].spans_intercept if isinstance(kinds[f], Coded) else None
    if o["cluster_by"] == "numerical_factors":
        numeric = lambda t: tuple(f for f in t if not isinstance(kinds[f], Coded))
        groups = list(dict.fromkeys(numeric(t) for t in terms))
        terms = sorted(terms, key=lambda t: (groups.index(numeric(t)), len(t)))
    made: list[tuple[str, list[Block]]] = []
    for term, parts in zip(terms, scoped_terms(terms, spans, o["ensure_full_rank"])):
        own: list[Block] = []
        for part in parts:
            if not part:
                if o["add_column_for_intercept"]:
                    own.append(Numeric(F.lit(1.0), o["intercept_name"], o["intercept_name"]))
                continue
            own += [replace(b, term=o["interaction_separator"].join(f.strip("`") for f in term)) for b in _piece(factors, part, o)]
        made.append((o["interaction_separator"].join(f.strip("`") for f in term) or o["intercept_name"], own))
    if spec.structure is None:
        spec.structure = [[term, _column_names(own)] for term, own in made]
    else:
        made = repaired(made, spec.structure)
    blocks = [b for _, own in made for b in own]
    few = o.get("cat_threshold") or 0
    blocks = [x for b in blocks for x in ([b.column(k) for k in range(b.width)] if isinstance(b, Categorical) and len(b.levels) < few else [b])]
    by_combination = any(isinstance(getattr(b, "levels", None), LevelTable) for b in blocks)
    m = DesignMatrix(factors.df, tuple(blocks), row_id, spec, coded_rows if by_combination else None)
    if o.get("sparse_threshold") is not None:
        m = m.split_density(o["sparse_threshold"])
    if o.get("dtype") is not None:
        m = m.astype(o["dtype"])
    spec.names = [n for _, names in spec.structure for n in names]
    return m


def _column_names(blocks: Sequence[Block]) -> list[str]:
    """Names of columns; many of them follow from the levels, which a replay takes from the spec."""
    return [n for b in blocks for n in ([f"{b.name} x {b.width}"] if isinstance(b, Categorical) and isinstance(b.levels, (Names, LevelTable)) else b.names())]


def repaired(made: Sequence[tuple[str, list[Block]]], structure: Sequence) -> list[tuple[str, list[Block]]]:
    """The rebuilt terms in the columns that training had, term by term.

    A term that gives no column now is zero in all columns it had.  One that gives a single
    numeric column has it under each of their names.  Any other difference is a StructureError.
    """
    if [t for t, _ in made] != [t for t, _ in structure]:
        raise StructureError(f"the data give the terms {[t for t, _ in made]}, training had {[t for t, _ in structure]}")
    out = []
    for (term, own), (_, wanted) in zip(made, structure):
        names = _column_names(own)
        if names == list(wanted):
            out.append((term, own))
        elif not names:
            out.append((term, [Numeric(F.lit(0.0), n, term, SPARSE) for n in wanted]))
        elif len(names) == 1 < len(wanted) and isinstance(own[0], Numeric):
            out.append((term, [replace(own[0], name=n) for n in wanted]))
        else:
            raise StructureError(f"term {term} gives the columns {names}, training had {list(wanted)}")
    return out


def from_formula(
    formula: str,
    df: DataFrame,
    ensure_full_rank: bool = False,
    na_action: str = "ignore",
    include_intercept: bool = False,
    add_column_for_intercept: bool = True,
    intercept_name: str = "Intercept",
    interaction_separator: str = ":",
    categorical_format: str = "{name}[{category}]",
    cat_missing_method: str = "fail",
    cat_missing_name: str = "(MISSING)",
    cluster_by: str | None = None,
    context: Mapping[str, object] | None = None,
    row_id: str | None = None,
    dtype: str | None = None,
    sparse_threshold: float | None = None,
    cat_threshold: int | None = None,
    interactions: str = "all",
) -> DesignMatrix | tuple[DesignMatrix, DesignMatrix]:
    """The matrix of a formula, with ``spec`` for replay; with ``~``, left and right side.

    ``context`` gives scalars and Column-returning functions that the formula may name.
    ``sparse_threshold`` marks numeric columns dense or sparse, at the price of a pass over
    the data; categoricals of fewer than ``cat_threshold`` levels become numeric columns.
    Neither changes a value, so neither is done unless asked for.  With ``interactions``
    "observed", an interaction of categoricals has columns only for combinations that occur.
    """
    if interactions not in ("all", "observed"):
        raise ValueError("interactions must be 'all' or 'observed'")
    if na_action not in ("ignore", "drop", "raise"):
        raise ValueError("na_action must be 'ignore', 'drop' or 'raise'")
    options = dict(ensure_full_rank=ensure_full_rank, na_action=na_action, include_intercept=include_intercept, add_column_for_intercept=add_column_for_intercept, intercept_name=intercept_name, interaction_separator=interaction_separator, categorical_format=categorical_format, cat_missing_method=cat_missing_method, cat_missing_name=cat_missing_name, cluster_by=cluster_by, dtype=dtype, sparse_threshold=sparse_threshold, cat_threshold=cat_threshold, interactions=interactions)
    left, tilde, right = sides(formula)
    asked = {f for t in (parse_terms(left, False, df.columns) if left.strip() else []) for f in t}
    named = {n.id for f in asked for n in ast.walk(ast.parse(f.strip("`") if not f.startswith("`") else repr(f), mode="eval")) if isinstance(n, ast.Name)} | {f.strip("`") for f in asked}
    others = [c for c in df.columns if c not in named and c != row_id]
    rhs = _build(df, Spec(right, options, context=dict(context or {}), others=others), row_id)
    if not tilde or not left.strip():
        return rhs
    return _build(df, Spec(left, options | {"include_intercept": False}, context=dict(context or {}), others=others), row_id), rhs

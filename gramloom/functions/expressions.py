"""Expressions of formulas as Columns: a typed compiler over Python's syntax tree.

Three kinds of values: numbers (double Columns or Python numbers), flags (true or false, a
:class:`Flag`), and text.  Arithmetic reads a flag as 0 or 1; ``&``, ``|``, ``^`` and ``~``,
as well as ``and``, ``or`` and ``not``, take flags only.

One rule for what is missing (null and NaN alike): arithmetic, functions and element-wise
minimum and maximum of anything missing are missing; a comparison with it is false, and ``!=``
true, as with NaN in NumPy; so a flag is never missing unless it is a missing boolean of the
data.  Division and remainder by zero are missing.  The remainder has the sign of the divisor.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class StructureError(ValueError):
    """Replayed rows give columns that cannot be brought into those of training."""


@dataclass(frozen=True)
class Flag:
    """A boolean Column, kept apart from numbers."""

    column: Column


def flag(c: Column) -> Flag:
    return Flag(c)


def number(x):
    """A value as a number: flags as 0 and 1."""
    return x.column.cast("double") if isinstance(x, Flag) else float(x) if isinstance(x, bool) else x


def _column(x) -> Column:
    x = number(x)
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, (int, float)) else F.lit(x)


def _known(*xs: Column) -> Column:
    """That none is null or NaN; text is never NaN."""
    return reduce(lambda a, b: a & b, [x.isNotNull() for x in xs])


def _divided(a, b):
    return F.try_divide(_column(a).cast("double"), _column(b).cast("double"))


def _remainder(a, b):
    a, b = _column(a).cast("double"), _column(b).cast("double")
    r = F.when(b != 0, a % F.when(b != 0, b))
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def _power(a, b):
    return F.pow(_column(a), _column(b))


_ARITHMETIC: dict[type, Callable] = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: _divided(a, b) if isinstance(a, Column) or isinstance(b, Column) else a / b,
    ast.FloorDiv: lambda a, b: F.floor(_divided(a, b)).cast("double") if isinstance(a, Column) or isinstance(b, Column) else a // b,
    ast.Mod: lambda a, b: _remainder(a, b) if isinstance(a, Column) or isinstance(b, Column) else a % b,
    ast.Pow: lambda a, b: _power(a, b) if isinstance(a, Column) or isinstance(b, Column) else a**b,
}
_COMPARISONS: dict[type, Callable[[Column, Column], Column]] = {
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
}
_LOGIC: dict[type, Callable[[Column, Column], Column]] = {
    ast.BitAnd: lambda a, b: a & b,
    ast.BitOr: lambda a, b: a | b,
    ast.BitXor: lambda a, b: a != b,
}


def _extreme(pick: Callable) -> Callable:
    def of(a, b):
        a, b = _column(a), _column(b)
        return F.when(_known(a, b), pick(a, b))

    return of


def _where(condition, a, b) -> Column | Flag:
    both_flags = isinstance(a, (Flag, bool)) and isinstance(b, (Flag, bool))
    out = F.when(as_flag(condition), _column(a)).otherwise(_column(b))
    return Flag(out != 0) if both_flags else out


def as_flag(x) -> Column:
    if isinstance(x, Flag):
        return x.column
    if isinstance(x, bool):
        return F.lit(x)
    raise ValueError("true or false is needed here, not a number; compare it with something")


#: Functions by name, with or without a module before it.
BUILT_IN: dict[str, Callable] = {
    "I": lambda x: x,
    "log": lambda x: F.log(_column(x)),
    "log1p": lambda x: F.log1p(_column(x)),
    "log2": lambda x: F.log2(_column(x)),
    "log10": lambda x: F.log10(_column(x)),
    "exp": lambda x: F.exp(_column(x)),
    "expm1": lambda x: F.expm1(_column(x)),
    "sqrt": lambda x: F.sqrt(_column(x)),
    "cbrt": lambda x: F.cbrt(_column(x)),
    "square": lambda x: _column(x) * _column(x),
    "abs": lambda x: F.abs(_column(x)),
    "absolute": lambda x: F.abs(_column(x)),
    "sign": lambda x: F.signum(_column(x)),
    "floor": lambda x: F.floor(_column(x)).cast("double"),
    "ceil": lambda x: F.ceil(_column(x)).cast("double"),
    "rint": lambda x: F.rint(_column(x)),
    "sin": lambda x: F.sin(_column(x)),
    "cos": lambda x: F.cos(_column(x)),
    "tan": lambda x: F.tan(_column(x)),
    "arctan": lambda x: F.atan(_column(x)),
    "tanh": lambda x: F.tanh(_column(x)),
    "power": _power,
    "mod": _remainder,
    "minimum": _extreme(F.least),
    "maximum": _extreme(F.greatest),
    "clip": lambda x, low, high: _extreme(F.least)(_extreme(F.greatest)(x, low), high),
    "isnan": lambda x: Flag(_column(x).isNull()),
    "logical_and": lambda a, b: Flag(as_flag(a) & as_flag(b)),
    "logical_or": lambda a, b: Flag(as_flag(a) | as_flag(b)),
    "logical_not": lambda a: Flag(~as_flag(a)),
    "where": _where,
}


class Compiler:
    """``named`` gives the value of a name; ``called`` that of a call, or NotImplemented for what is built in."""

    def __init__(self, named: Callable, called: Callable):
        self.named, self.called = named, called

    def value(self, node: ast.AST):
        found = getattr(self, f"_{type(node).__name__}", None)
        if found is None:
            raise ValueError(f"{ast.unparse(node)!r} is not supported in a formula")
        return found(node)

    def _Constant(self, node: ast.Constant):
        return node.value

    def _Name(self, node: ast.Name):
        return self.named(node.id)

    def _List(self, node: ast.List):
        return [self.value(x) for x in node.elts]

    def _Tuple(self, node: ast.Tuple):
        return [self.value(x) for x in node.elts]

    def _UnaryOp(self, node: ast.UnaryOp):
        x = self.value(node.operand)
        if isinstance(node.op, (ast.Not, ast.Invert)):
            return Flag(~as_flag(x))
        return -number(x) if isinstance(node.op, ast.USub) else number(x)

    def _BinOp(self, node: ast.BinOp):
        a, b = self.value(node.left), self.value(node.right)
        if type(node.op) in _LOGIC:
            return Flag(_LOGIC[type(node.op)](as_flag(a), as_flag(b)))
        if type(node.op) not in _ARITHMETIC or isinstance(a, (str, list)) or isinstance(b, (str, list)):
            raise ValueError(f"{ast.unparse(node)!r} is not supported in a formula")
        return _ARITHMETIC[type(node.op)](number(a), number(b))

    def _BoolOp(self, node: ast.BoolOp):
        parts = [as_flag(self.value(x)) for x in node.values]
        return Flag(reduce(lambda a, b: a & b if isinstance(node.op, ast.And) else a | b, parts))

    def _Compare(self, node: ast.Compare):
        """Chains, ``a < b < c``, are all of their parts; ``in`` takes a list."""
        values, parts = [self.value(x) for x in (node.left, *node.comparators)], []
        for op, a, b in zip(node.ops, values, values[1:]):
            if isinstance(op, (ast.In, ast.NotIn)) and isinstance(b, list):
                held = F.coalesce(_column(a).isin([number(x) for x in b]), F.lit(False))
                parts.append(~held if isinstance(op, ast.NotIn) else held)
            elif type(op) in _COMPARISONS:
                parts.append(F.coalesce(_COMPARISONS[type(op)](_column(a), _column(b)), F.lit(isinstance(op, ast.NotEq))))
            else:
                raise ValueError(f"{ast.unparse(node)!r} is not supported in a formula")
        return Flag(reduce(lambda a, b: a & b, parts))

    def _IfExp(self, node: ast.IfExp):
        return _where(self.value(node.test), self.value(node.body), self.value(node.orelse))

    def _Call(self, node: ast.Call):
        name = node.func.attr if isinstance(node.func, ast.Attribute) else node.func.id if isinstance(node.func, ast.Name) else None
        # functions of the context get plain Columns
        plain = lambda x: x.column if isinstance(x, Flag) else x
        out = self.called(node, name, lambda: [plain(self.value(a)) for a in node.args], lambda: {k.arg: plain(self.value(k.value)) for k in node.keywords})
        if out is not NotImplemented:
            return out
        if name not in BUILT_IN:
            raise ValueError(f"{ast.unparse(node)!r} is not supported in a formula")
        return BUILT_IN[name](*[self.value(a) for a in node.args], **{k.arg: self.value(k.value) for k in node.keywords})

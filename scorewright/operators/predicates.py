"""Row predicates written as Python expressions over a data frame, compiled to Columns.

Settings of older pipelines hold texts like ``inds["age"].between(18, 65) & ~inds["state"].isin(["NY"])``.
They are parsed, never evaluated: each node of the syntax tree must be one of a
closed list, everything else is refused with its place in the text.

A mask behaves as it does over a data frame, not as SQL's three-valued logic: a
comparison with a missing value is false, ``!=`` with one is true, and so ``~``
turns every row around.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The name under which a text speaks of the table, unless told otherwise.
TABLE = "inds"
_COMPARE = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}
_ARITHMETIC = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.Mod: "%", ast.Pow: "**"}
_ISNA, _NOTNA = ("isna", "isnull"), ("notna", "notnull")


class PredicateError(ValueError):
    """A text that isn't a predicate of the allowed kind, with the place where it isn't."""

    def __init__(self, text: str, node: ast.AST | None, why: str):
        part = ast.get_source_segment(text, node) if node is not None else None
        at = f"column {node.col_offset + 1} of line {node.lineno}, {part!r}: " if node is not None else ""
        super().__init__(f"{at}{why}")


@dataclass
class _Part:
    """A compiled node: ``kind`` is number, text, time, mask (true or false, never null), other; ``plain`` holds a literal."""

    kind: str
    column: Column
    plain: object = None
    literal: bool = False


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "mask"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    return "time" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "other"


class _Compiler:
    def __init__(self, df: DataFrame, text: str, names: Mapping[str, object]):
        self.fields, self.text, self.names = {f.name: f for f in df.schema.fields}, text, names

    def refuse(self, node: ast.AST, why: str) -> PredicateError:
        return PredicateError(self.text, node, why)

    def column(self, node: ast.AST, name: object) -> _Part:
        if not isinstance(name, str) or name not in self.fields:
            raise self.refuse(node, f"the table has no column {name!r}")
        field, c = self.fields[name], F.col("`" + name.replace("`", "``") + "`")
        kind = _kind(field.dataType)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)  # a missing number is null or nan
        return _Part(kind, F.coalesce(c, F.lit(False)) if kind == "mask" else c)

    def literal(self, value: object) -> _Part:
        kind = "mask" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "text"
        return _Part(kind, F.lit(value), value, True)

    def constant(self, node: ast.AST) -> object:
        """A literal, or a name of the settings that stands for one; None is not one."""
        if isinstance(node, ast.Constant) and isinstance(node.value, (bool, int, float, str)):
            return node.value
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant) and type(node.operand.value) in (int, float):
            return -node.operand.value
        if isinstance(node, ast.Name) and isinstance(self.names.get(node.id), (bool, int, float, str)):
            return self.names[node.id]
        raise self.refuse(node, "a text, a number, True or False is expected here")

    def _is_table(self, node: ast.AST) -> bool:
        return isinstance(node, ast.Name) and node.id == TABLE

    def part(self, node: ast.AST) -> _Part:
        made = {ast.Constant: self._constant, ast.Name: self._constant, ast.Subscript: self._subscript, ast.Attribute: self._attribute, ast.UnaryOp: self._unary, ast.BinOp: self._binary, ast.Compare: self._compare, ast.Call: self._call}
        if type(node) is ast.BoolOp:
            raise self.refuse(node, "masks are joined by & and |, each side in brackets")
        if type(node) not in made:
            raise self.refuse(node, f"{type(node).__name__} is not allowed in a predicate")
        return made[type(node)](node)

    def mask(self, node: ast.AST) -> _Part:
        made = self.part(node)
        if made.kind != "mask":
            raise self.refuse(node, "a mask is expected here, a comparison for instance")
        return made

    def _constant(self, node: ast.AST) -> _Part:
        if self._is_table(node):
            raise self.refuse(node, "a column of the table is expected, not the table itself")
        if isinstance(node, ast.Constant) and node.value is None:
            raise self.refuse(node, "missing values are asked for by isna()")
        if isinstance(node, ast.Name) and node.id not in self.names:
            raise self.refuse(node, f"unknown name {node.id!r}")
        return self.literal(self.constant(node))

    def _subscript(self, node: ast.Subscript) -> _Part:
        if not self._is_table(node.value):
            raise self.refuse(node, f"only {TABLE}[...] with one column name is allowed")
        return self.column(node, self.constant(node.slice))

    def _attribute(self, node: ast.Attribute) -> _Part:
        if not self._is_table(node.value):
            raise self.refuse(node, f"attribute {node.attr!r} is not allowed here")
        return self.column(node, node.attr)

    def _unary(self, node: ast.UnaryOp) -> _Part:
        if isinstance(node.op, ast.Invert):
            return _Part("mask", ~self.mask(node.operand).column)
        if isinstance(node.op, ast.Not):
            raise self.refuse(node, "a mask is negated by ~")
        made = self.part(node.operand)
        if made.kind != "number":
            raise self.refuse(node, "only numbers have a sign")
        return _Part("number", -made.column if isinstance(node.op, ast.USub) else made.column)

    def _binary(self, node: ast.BinOp) -> _Part:
        if isinstance(node.op, (ast.BitAnd, ast.BitOr, ast.BitXor)):
            a, b = self.mask(node.left).column, self.mask(node.right).column
            return _Part("mask", a & b if isinstance(node.op, ast.BitAnd) else a | b if isinstance(node.op, ast.BitOr) else a != b)
        sign = _ARITHMETIC.get(type(node.op))
        if sign is None:
            raise self.refuse(node, f"{type(node.op).__name__} is not allowed in a predicate")
        a, b = self.part(node.left), self.part(node.right)
        if sign == "+" and a.kind == b.kind == "text":
            return _Part("text", F.concat(a.column, b.column))
        if a.kind != "number" or b.kind != "number":
            raise self.refuse(node, f"{sign} needs numbers")
        return _Part("number", _number(sign, a.column.cast("double"), b.column.cast("double")))

    def _compare(self, node: ast.Compare) -> _Part:
        if len(node.ops) != 1:
            raise self.refuse(node, "a chain of comparisons has no mask; join two by &")
        sign = _COMPARE.get(type(node.ops[0]))
        if sign is None:
            raise self.refuse(node, f"{type(node.ops[0]).__name__} is not allowed; isin() and isna() serve")
        return self.compared(node, sign, self.part(node.left), self.part(node.comparators[0]))

    def compared(self, node: ast.AST, sign: str, a: _Part, b: _Part) -> _Part:
        pair = {a.kind, b.kind}
        if pair == {"time", "text"} and (a.literal or b.literal):
            a, b = (_Part("time", x.column.try_cast("timestamp") if x.kind == "text" else x.column) for x in (a, b))
        elif pair == {"mask", "number"}:
            a, b = (_Part("number", x.column.cast("int") if x.kind == "mask" else x.column) for x in (a, b))
        elif len(pair) > 1:
            # Values of different kinds are never equal, and have no order.
            if sign in ("==", "!="):
                return _Part("mask", F.lit(sign == "!="))
            raise self.refuse(node, f"{sign} between {a.kind} and {b.kind}")
        x, y = a.column, b.column
        made = {"==": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}[sign]()
        return _Part("mask", F.coalesce(made, F.lit(sign == "!=")))

    def _arguments(self, node: ast.Call, order: list[str], **defaults) -> dict[str, object]:
        """Arguments by name; the nodes of those without a default value."""
        out: dict[str, object] = dict(defaults)
        if len(node.args) > len(order):
            raise self.refuse(node, "too many arguments")
        given = [*zip(order, node.args), *((k.arg, k.value) for k in node.keywords)]
        for name, value in given:
            if name not in order or isinstance(value, ast.Starred):
                raise self.refuse(value, f"argument {name!r} is not allowed")
            out[name] = self.constant(value) if name in defaults else value
        if missing := [n for n in order if n not in out]:
            raise self.refuse(node, f"argument {missing[0]!r} is missing")
        return out

    def _call(self, node: ast.Call) -> _Part:
        f = node.func
        if isinstance(f, ast.Name) and f.id == "abs":
            return self._abs(node, self.part(self._arguments(node, ["x"])["x"]))
        if not isinstance(f, ast.Attribute):
            raise self.refuse(node, "only methods of a column, abs() and pd.isna() are allowed")
        if isinstance(f.value, ast.Name) and f.value.id in ("pd", "np") and f.value.id not in self.names:
            return self._function(node, f)
        if isinstance(f.value, ast.Attribute) and f.value.attr == "str" and not self._is_table(f.value.value):
            return self._text_method(node, f.attr, self.part(f.value.value))
        return self._method(node, f.attr, self.part(f.value))

    def _abs(self, node: ast.AST, x: _Part) -> _Part:
        if x.kind != "number":
            raise self.refuse(node, "abs() needs a number")
        return _Part("number", F.abs(x.column))

    def _function(self, node: ast.Call, f: ast.Attribute) -> _Part:
        if f.attr not in (*_ISNA, *_NOTNA, "isnan", "abs"):
            raise self.refuse(node, f"{f.value.id}.{f.attr} is not allowed")
        x = self.part(self._arguments(node, ["x"])["x"])
        return self._abs(node, x) if f.attr == "abs" else _Part("mask", x.column.isNotNull() if f.attr in _NOTNA else x.column.isNull())

    def _method(self, node: ast.Call, name: str, x: _Part) -> _Part:
        if name in (*_ISNA, *_NOTNA):
            self._arguments(node, [])
            return _Part("mask", x.column.isNull() if name in _ISNA else x.column.isNotNull())
        if name == "abs":
            self._arguments(node, [])
            return self._abs(node, x)
        if name in ("eq", "ne", "lt", "le", "gt", "ge"):
            sign = dict(eq="==", ne="!=", lt="<", le="<=", gt=">", ge=">=")[name]
            return self.compared(node, sign, x, self.part(self._arguments(node, ["other"])["other"]))
        if name == "isin":
            values = self._arguments(node, ["values"])["values"]
            if not isinstance(values, (ast.List, ast.Tuple, ast.Set)):
                raise self.refuse(values, "isin() takes a list of literals")
            alike = [v for v in map(self.constant, values.elts) if self.literal(v).kind == x.kind or x.kind == "time" and isinstance(v, str)]
            if not alike:
                return _Part("mask", F.lit(False))
            some = [F.lit(v).try_cast("timestamp") if x.kind == "time" else F.lit(v) for v in alike]
            return _Part("mask", F.coalesce(x.column.isin(*some), F.lit(False)))
        if name == "between":
            got = self._arguments(node, ["left", "right", "inclusive"], inclusive="both")
            if got["inclusive"] not in ("both", "neither", "left", "right"):
                raise self.refuse(node, "inclusive is one of both, neither, left, right")
            low = self.compared(node, ">=" if got["inclusive"] in ("both", "left") else ">", x, self.part(got["left"]))
            high = self.compared(node, "<=" if got["inclusive"] in ("both", "right") else "<", x, self.part(got["right"]))
            return _Part("mask", low.column & high.column)
        if name == "fillna":
            value = self.literal(self.constant(self._arguments(node, ["value"])["value"]))
            if value.kind != x.kind:
                raise self.refuse(node, f"a {value.kind} can't stand for a missing {x.kind}")
            return _Part(x.kind, F.coalesce(x.column, value.column))
        raise self.refuse(node, f"method {name!r} is not allowed")

    def _text_method(self, node: ast.Call, name: str, x: _Part) -> _Part:
        if x.kind != "text":
            raise self.refuse(node, ".str needs a text column")
        c = x.column
        plain: dict[str, Callable[[], _Part]] = {
            "lower": lambda: _Part("text", F.lower(c)),
            "upper": lambda: _Part("text", F.upper(c)),
            "strip": lambda: _Part("text", F.regexp_replace(c, r"^\s+|\s+$", "")),
            "len": lambda: _Part("number", F.char_length(c)),
        }
        if name in plain:
            self._arguments(node, [])
            return plain[name]()
        if name in ("startswith", "endswith"):
            got = self._arguments(node, ["pat", "na"], na=False)
            pat = self.constant(got["pat"])
            hit = c.startswith(F.lit(pat)) if name == "startswith" else c.endswith(F.lit(pat))
        elif name == "contains":
            got = self._arguments(node, ["pat", "case", "flags", "na", "regex"], case=True, flags=0, na=False, regex=True)
            pat = self.constant(got["pat"])
            if got["flags"] != 0 or not isinstance(pat, str):
                raise self.refuse(node, "contains() takes a text, without flags")
            if got["regex"]:
                hit = c.rlike(pat if got["case"] else f"(?iu){pat}")
            else:
                hit = c.contains(F.lit(pat)) if got["case"] else F.lower(c).contains(F.lower(F.lit(pat)))
        else:
            raise self.refuse(node, f".str.{name} is not allowed")
        if not isinstance(pat, str):
            raise self.refuse(node, "a text is expected")
        return _Part("mask", F.coalesce(hit, F.lit(bool(got["na"]))))


def _number(sign: str, a: Column, b: Column) -> Column:
    """Arithmetic of doubles; null where either is null or the result is no number."""
    some = F.when(b != 0, b)
    if sign == "/":
        by_zero = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf))
        return F.when(b == 0, by_zero).otherwise(a / some)
    if sign in ("//", "%"):
        down = F.floor(a / some).cast("double")
        return down if sign == "//" else a - down * some
    made = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "**": lambda: F.pow(a, b)}[sign]()
    return F.when(~F.isnan(made), made)


def compile_predicate(df: DataFrame, text: str, names: Mapping[str, object] | None = None) -> Column:
    """The mask of a Python text as a Column that is true or false for every row of ``df``.

    The table is called ``inds``; ``names`` gives texts, numbers and booleans that
    names in the text stand for, as in ``inds[dep_var].isna()``.  Allowed are
    columns by ``inds["x"]`` or ``inds.x``, literals, comparisons, ``& | ^ ~``,
    arithmetic, ``isin isna isnull notna notnull between fillna abs eq ne lt le
    gt ge``, ``str.lower upper strip len startswith endswith contains``,
    ``pd.isna`` and its kin, ``np.isnan``, ``abs``.  Anything else raises
    PredicateError.  A null or nan is missing; text methods give false for it
    unless ``na=True``; division by zero gives infinity, zero by zero a missing
    value.
    """
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except (SyntaxError, ValueError, RecursionError) as e:
        raise PredicateError(text, None, f"not a Python expression: {e}") from None
    return _Compiler(df, text.strip(), names or {}).mask(tree.body).column


def speaks_of_table(text: str) -> bool:
    """Whether a text is a Python expression over ``inds`` rather than SQL."""
    try:
        return any(isinstance(n, ast.Name) and n.id == TABLE for n in ast.walk(ast.parse(text.strip(), mode="eval")))
    except (SyntaxError, ValueError, RecursionError):
        return False

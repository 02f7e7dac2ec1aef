"""Rule expressions as Spark SQL.

An expression is read with `ast` when the plan is built and becomes the text of one
SQL expression, so that a plan of a thousand rules is parsed in one go; only
built-in functions reach the executors. Messages alone are filled in Arrow batches,
of what is reported. An operand error makes a whole rule fail, so NULL stands for
"error" and the logical operators short-circuit from left to right as in the source
language; see `predicate_sql`.
"""

from __future__ import annotations

import ast
import string
from collections.abc import Callable, Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = (T.IntegralType, T.FractionalType, T.DecimalType, T.BooleanType)
_ORDER = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}
_NO_NUMBER, _NO_TEXT, _ERROR = "CAST(NULL AS DOUBLE)", "CAST(NULL AS STRING)", "CAST(NULL AS BOOLEAN)"


class Bound(NamedTuple):
    """A rule's input: its SQL, and whether it is text."""

    sql: str
    text: bool

    @property
    def column(self) -> Column:
        return F.expr(self.sql)


def quoted(text: str) -> str:
    """A text as a literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _named(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def bind_inputs(entities: DataFrame, names: Iterable[str], properties: str = "properties") -> dict[str, Bound]:
    """name -> its input: a declared column first, else the open property, else null."""
    bound = {}
    for name in names:
        if name in entities.columns and name != properties:
            kind = entities.schema[name].dataType
            text = isinstance(kind, T.StringType)
            bound[name] = Bound(_named(name) if text else f"CAST({_named(name)} AS {'DOUBLE' if isinstance(kind, _NUMBER) else 'STRING'})", text)
        elif properties in entities.columns:
            path = quoted("$." + name)
            bound[name] = Bound(f"try_variant_get({_named(properties)}, {path}, 'double')", False)
        else:
            bound[name] = Bound(_NO_NUMBER, False)
    return bound


class _Compiler:
    def __init__(self, inputs: dict[str, Bound]) -> None:
        self.inputs = inputs

    def value(self, node: ast.AST) -> Bound:
        """SQL of a value; null is an error or a missing input."""
        if isinstance(node, ast.Name):
            if node.id not in self.inputs:
                raise ValueError(f"unknown name {node.id}")
            return self.inputs[node.id]
        if isinstance(node, ast.Constant):
            if isinstance(node.value, str):
                return Bound(quoted(node.value), True)
            if node.value is None:
                return Bound(_NO_NUMBER, False)
            if isinstance(node.value, (bool, int, float)):
                return Bound(f"CAST({quoted(repr(float(node.value)))} AS DOUBLE)", False)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            x = self.value(node.operand)
            return Bound(_NO_NUMBER if x.text else f"(- {x.sql})" if isinstance(node.op, ast.USub) else x.sql, False)
        if isinstance(node, ast.BinOp):
            a, b = self.value(node.left), self.value(node.right)
            if a.text or b.text:
                return Bound(_NO_NUMBER, False)
            if isinstance(node.op, ast.Div):
                return Bound(f"try_divide({a.sql}, {b.sql})", False)
            if isinstance(node.op, ast.Mod):
                # the sign follows the divisor
                return Bound(f"try_mod(try_mod({a.sql}, {b.sql}) + {b.sql}, {b.sql})", False)
            for kind, sign in ((ast.Add, "+"), (ast.Sub, "-"), (ast.Mult, "*")):
                if isinstance(node.op, kind):
                    return Bound(f"({a.sql} {sign} {b.sql})", False)
        if isinstance(node, (ast.BoolOp, ast.Compare)) or isinstance(node, ast.UnaryOp):
            return Bound(f"CAST({self.truth(node)} AS DOUBLE)", False)
        raise ValueError(f"not allowed in a rule: {ast.dump(node)}")

    def truth(self, node: ast.AST) -> str:
        if isinstance(node, ast.BoolOp):
            out = self.truth(node.values[-1])
            for left in map(self.truth, reversed(node.values[:-1])):
                keep, other = ("TRUE", out) if isinstance(node.op, ast.Or) else (out, "FALSE")
                out = f"CASE WHEN {left} IS NULL THEN {_ERROR} WHEN {left} THEN {keep} ELSE {other} END"
            return f"({out})"
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return f"(NOT {self.truth(node.operand)})"
        if isinstance(node, ast.Compare):
            parts, left = [], node.left
            for op, right in zip(node.ops, node.comparators, strict=True):
                parts.append(self.compare(left, op, right))
                left = right
            out = parts[-1]
            for part in reversed(parts[:-1]):
                out = f"CASE WHEN {part} IS NULL THEN {_ERROR} WHEN {part} THEN {out} ELSE FALSE END"
            return f"({out})"
        if isinstance(node, ast.Constant) and isinstance(node.value, bool):
            return "TRUE" if node.value else "FALSE"
        x = self.value(node)
        return f"coalesce({x.sql} <> {quoted('')}, FALSE)" if x.text else f"coalesce({x.sql} <> 0, FALSE)"

    def compare(self, left: ast.AST, op: ast.cmpop, right: ast.AST) -> str:
        a, b = self.value(left), self.value(right)
        if isinstance(op, (ast.Is, ast.IsNot)):
            if not (isinstance(right, ast.Constant) and right.value is None):
                raise ValueError("only `is None` and `is not None` are allowed")
            return f"({a.sql} IS {'' if isinstance(op, ast.Is) else 'NOT '}NULL)"
        if isinstance(op, (ast.Eq, ast.NotEq)):
            missing = [isinstance(x, ast.Constant) and x.value is None for x in (left, right)]
            if a.text != b.text and not any(missing):
                same = "FALSE"
            elif any(missing):
                same = f"({(a if missing[1] else b).sql} IS NULL)"
            else:
                same = f"({a.sql} <=> {b.sql})" if a.text else f"({a.sql} <=> {b.sql} AND NOT coalesce(isnan({a.sql}), FALSE))"
            for x, bound in ((left, a), (right, b)):
                if not isinstance(x, (ast.Name, ast.Constant)):
                    same = f"(CASE WHEN {bound.sql} IS NULL THEN {_ERROR} ELSE {same} END)"
            return same if isinstance(op, ast.Eq) else f"(NOT {same})"
        if type(op) in _ORDER:
            if a.text != b.text:
                return _ERROR
            order = f"({a.sql} {_ORDER[type(op)]} {b.sql})"
            if a.text:
                return order
            return f"(CASE WHEN isnan({a.sql}) OR isnan({b.sql}) THEN CASE WHEN {a.sql} IS NULL OR {b.sql} IS NULL THEN {_ERROR} ELSE FALSE END ELSE {order} END)"
        raise ValueError(f"not allowed in a rule: {ast.dump(op)}")


def predicate_sql(expression: str, inputs: dict[str, Bound]) -> str:
    """True where the expression holds; false where it does not or an operand is in error."""
    return f"coalesce({_Compiler(inputs).truth(ast.parse(expression, mode='eval').body)}, FALSE)"


def predicate_column(expression: str, inputs: dict[str, Bound]) -> Column:
    return F.expr(predicate_sql(expression, inputs))


def measured_sql(names: Iterable[str], inputs: dict[str, Bound], suppress: bool = False) -> str:
    """The first non-null numeric input in declared order, or null."""
    numbers = [inputs[n].sql for n in names if not inputs[n].text]
    return f"coalesce({', '.join(numbers)})" if numbers and not suppress else _NO_NUMBER


def measured(names: Iterable[str], inputs: dict[str, Bound], suppress: bool = False) -> Column:
    return F.expr(measured_sql(names, inputs, suppress))


def value_kinds(entities: DataFrame, names: Iterable[str]) -> dict[str, str]:
    """How a bound input shows in a message: as text, int, bool or float (open properties are floats)."""
    kinds = {}
    for name in names:
        kind = entities.schema[name].dataType if name in entities.columns else T.DoubleType()
        kinds[name] = "bool" if isinstance(kind, T.BooleanType) else "int" if isinstance(kind, T.IntegralType) else "float" if isinstance(kind, _NUMBER) else "text"
    return kinds


_SHOWN = {"int": int, "bool": bool, "float": float, "text": str}


class Template:
    """A message with named placeholders in the format language, and the inputs that it may name."""

    def __init__(self, text: str, kinds: dict[str, str]) -> None:
        self.text, self.kinds = text, kinds
        try:
            self.plain = all(name is None or name in kinds for _, name, _, _ in string.Formatter().parse(text))
        except ValueError:
            self.plain = False

    def fill(self, numbers: list[float | None], texts: list[str | None]) -> str:
        """The message; a null shows as ?, and what cannot be formatted leaves the raw template."""
        if not self.plain:
            return self.text
        given = dict(zip(self.kinds, zip(self.kinds.values(), numbers, texts, strict=True), strict=True))
        values = {n: text if kind == "text" else number if number is None else _SHOWN[kind](number) for n, (kind, number, text) in given.items()}
        try:
            return self.text.format(**{n: "?" if v is None else v for n, v in values.items()})
        except (KeyError, ValueError, OverflowError, IndexError):
            return self.text


def message_arguments(inputs: dict[str, Bound]) -> tuple[str, str]:
    """SQL of the numbers and of the texts of a rule's inputs in order, for `messages`."""
    numbers = ", ".join(_NO_NUMBER if b.text else b.sql for b in inputs.values())
    texts = ", ".join(b.sql if b.text else _NO_TEXT for b in inputs.values())
    return f"CAST(array({numbers}) AS array<double>)", f"CAST(array({texts}) AS array<string>)"


def messages(templates: dict[str, Template]) -> Callable[..., Column]:
    """(rule id, numbers, texts) -> message, batch by batch; only rows that are to be reported should get here."""

    def fill(rules: pa.Array, numbers: pa.Array, texts: pa.Array) -> pa.Array:
        rows = zip(rules.to_pylist(), numbers.to_pylist(), texts.to_pylist(), strict=True)
        return pa.array([templates[r].fill(n, t) for r, n, t in rows], pa.string())

    # the annotations of a nested function are text under this module's future import
    fill.__annotations__ = {"rules": pa.Array, "numbers": pa.Array, "texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(fill, T.StringType())


def render_message(template: str, inputs: dict[str, Bound], kinds: dict[str, str] | None = None) -> Column:
    """Fill named placeholders as Python's format does; a null shows as ?, and with a number format on it the raw template comes back."""
    kinds = kinds or {n: "text" if b.text else "float" for n, b in inputs.items()}
    return messages({"": Template(template, kinds)})(F.lit(""), *map(F.expr, message_arguments(inputs)))

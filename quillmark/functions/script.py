"""Sort keys from scripts: expressions of one item that become Columns, and nothing else.

A script is a text of calls ``register_sort("name", lambda item: expression)``. It is read, never run: an
expression is made of the item's fields, texts, numbers, look-ups in written tables, and the operations
below, each of which is one of Spark's own. There are no loops, names, attributes or imports to reach
anything else with, so a key costs what its size costs, and sizes are bounded. Everything else is an error
that names the script and the place.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructType

from .columns import natural_key

#: Parts of one script's expressions, characters of its text, and of a text that it repeats or pads.
MAX_NODES, MAX_CHARS, MAX_PAD = 2000, 100_000, 10_000


class ScriptError(ValueError):
    """A script is no list of sort keys, or too large."""


@dataclass(frozen=True)
class Value:
    """A Column of a known kind: 'num', 'str', 'bool', or 'none' for a null of any."""

    column: Column
    kind: str


@dataclass(frozen=True)
class Key:
    """A registered expression; called with items it gives its value for their schema."""

    script: str
    body: ast.expr
    item: str

    def __call__(self, items: DataFrame) -> Value:
        return _Compiler(self.script, self.item, items.schema).value(self.body)


def _text(value: Value) -> Column:
    if value.kind == "num":  # whole numbers are written as such
        whole = value.column.cast("bigint")
        return F.when(whole == value.column, whole.cast("string")).otherwise(value.column.cast("string"))
    if value.kind == "bool":
        return F.when(value.column, "True").otherwise("False")
    return value.column


def _truth(value: Value) -> Column:
    told = {"num": lambda c: c != 0, "str": lambda c: c != "", "bool": lambda c: c, "none": lambda c: F.lit(False)}[value.kind]
    return F.coalesce(told(value.column), F.lit(False))


#: Functions and methods: the kinds of their arguments, the kind of the result, and how it is made.
FUNCTIONS: dict[str, tuple[str, str, Callable]] = {
    "len": ("str", "num", F.length),
    "abs": ("num", "num", F.abs),
    "floor": ("num", "num", F.floor),
    "ceil": ("num", "num", F.ceil),
    "float": ("str", "num", lambda c: F.try_to_number(c, F.lit("S999999999999999D999999")).cast("double")),
    "natural": ("str", "str", natural_key),
}
METHODS: dict[str, tuple[tuple[str, ...], str, Callable]] = {
    "lower": ((), "str", F.lower),
    "upper": ((), "str", F.upper),
    "strip": ((), "str", F.trim),
    "replace": (("str", "str"), "str", F.replace),
    "startswith": (("str",), "bool", F.startswith),
    "endswith": (("str",), "bool", F.endswith),
    "find": (("str",), "num", lambda c, part: F.instr(c, part) - 1),
}
COMPARISONS = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
ARITHMETIC = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a, b), ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a, b)), ast.Mod: lambda a, b: a - b * F.floor(F.try_divide(a, b))}


class _Compiler:
    def __init__(self, script: str, item: str, schema: StructType):
        self.script, self.item, self.schema = script, item, schema

    def refuse(self, node: ast.AST, why: str) -> ScriptError:
        return ScriptError(f"{self.script}:{getattr(node, 'lineno', 0)}: {why}")

    def value(self, node: ast.AST) -> Value:
        made = getattr(self, f"_{type(node).__name__}", None)
        if made is None:
            raise self.refuse(node, f"{type(node).__name__} is not allowed in a key")
        return made(node)

    def of_kind(self, node: ast.AST, kind: str) -> Column:
        value = self.value(node)
        if value.kind == "none":
            return value.column.cast({"num": "double", "str": "string", "bool": "boolean"}[kind])
        if kind == "num" and value.kind == "bool":
            return value.column.cast("int")
        if value.kind != kind:
            raise self.refuse(node, f"{kind} expected, not {value.kind}")
        return value.column

    def alike(self, node: ast.AST, *parts: ast.AST) -> tuple[list[Column], str]:
        """Values of one kind; nulls fit any."""
        values = [self.value(p) for p in parts]
        kinds = {v.kind for v in values} - {"none"}
        if kinds == {"num", "bool"}:
            kinds = {"num"}
        if len(kinds) > 1:
            raise self.refuse(node, f"{' and '.join(sorted(kinds))} in one place")
        kind = kinds.pop() if kinds else "none"
        return [v.column.cast("int") if kind == "num" and v.kind == "bool" else v.column for v in values], kind

    def _Constant(self, node: ast.Constant) -> Value:
        kind = {bool: "bool", int: "num", float: "num", str: "str", type(None): "none"}.get(type(node.value))
        if kind is None or kind == "num" and abs(node.value) >= 2**63:
            raise self.refuse(node, f"{node.value!r} is no text or number")
        return Value(F.lit(node.value), kind)

    def _Subscript(self, node: ast.Subscript) -> Value:
        if isinstance(node.value, ast.Name) and node.value.id == self.item:
            name = node.slice.value if isinstance(node.slice, ast.Constant) else None
            if name not in self.schema.names:
                raise self.refuse(node, f"an item has no {name!r}")
            kind = self.schema[name].dataType
            if not isinstance(kind, (NumericType, StringType)):
                raise self.refuse(node, f"{name} is no text or number")
            return Value(F.col(f"`{name}`"), "num" if isinstance(kind, NumericType) else "str")
        text = self.of_kind(node.value, "str")
        size = F.length(text)
        place = lambda part, absent: absent if part is None else F.when(self.of_kind(part, "num") < 0, F.greatest(size + self.of_kind(part, "num"), F.lit(0))).otherwise(F.least(self.of_kind(part, "num"), size)).cast("int")
        if isinstance(node.slice, ast.Slice):
            if node.slice.step is not None:
                raise self.refuse(node, "no steps in slices")
            start, end = place(node.slice.lower, F.lit(0)), place(node.slice.upper, size)
            return Value(F.substring(text, start + 1, F.greatest(end - start, F.lit(0))), "str")
        start = place(node.slice, F.lit(0))
        return Value(F.substring(text, start + 1, F.lit(1)), "str")

    def _BinOp(self, node: ast.BinOp) -> Value:
        if isinstance(node.op, ast.Add) and self.value(node.left).kind == "str":
            return Value(F.concat(self.of_kind(node.left, "str"), self.of_kind(node.right, "str")), "str")
        if type(node.op) not in ARITHMETIC:
            raise self.refuse(node, f"{type(node.op).__name__} is not allowed in a key")
        # Doubles: no overflow, whatever the script multiplies.
        left, right = (self.of_kind(n, "num").cast("double") for n in (node.left, node.right))
        return Value(ARITHMETIC[type(node.op)](left, right), "num")

    def _UnaryOp(self, node: ast.UnaryOp) -> Value:
        if isinstance(node.op, ast.Not):
            return Value(~_truth(self.value(node.operand)), "bool")
        if not isinstance(node.op, ast.USub):
            raise self.refuse(node, f"{type(node.op).__name__} is not allowed in a key")
        return Value(-self.of_kind(node.operand, "num").cast("double"), "num")

    def _BoolOp(self, node: ast.BoolOp) -> Value:
        columns, kind = self.alike(node, *node.values)
        value = Value(columns[-1], kind)
        for column in reversed(columns[:-1]):
            first = _truth(Value(column, kind))
            value = Value(F.when(first, value.column).otherwise(column) if isinstance(node.op, ast.And) else F.when(first, column).otherwise(value.column), kind)
        return value

    def _IfExp(self, node: ast.IfExp) -> Value:
        (yes, no), kind = self.alike(node, node.body, node.orelse)
        return Value(F.when(_truth(self.value(node.test)), yes).otherwise(no), kind)

    def _Compare(self, node: ast.Compare) -> Value:
        told, left = F.lit(True), node.left
        for op, right in zip(node.ops, node.comparators, strict=True):
            if isinstance(op, (ast.Is, ast.IsNot)) and isinstance(right, ast.Constant) and right.value is None:
                null = self.value(left).column.isNull()
                told = told & (null if isinstance(op, ast.Is) else ~null)
            elif isinstance(op, (ast.In, ast.NotIn)):
                found = F.coalesce(F.contains(self.of_kind(right, "str"), self.of_kind(left, "str")), F.lit(False))
                told = told & (found if isinstance(op, ast.In) else ~found)
            elif type(op) in COMPARISONS:
                (a, b), _ = self.alike(node, left, right)
                told = told & F.coalesce(COMPARISONS[type(op)](a, b), F.lit(False))
            else:
                raise self.refuse(node, f"{type(op).__name__} is not allowed in a key")
            left = right
        return Value(told, "bool")

    def _JoinedStr(self, node: ast.JoinedStr) -> Value:
        parts = [F.lit(p.value) if isinstance(p, ast.Constant) else self._formatted(p) for p in node.values]
        return Value(F.concat(*parts) if parts else F.lit(""), "str")

    def _formatted(self, node: ast.FormattedValue) -> Column:
        value = self.value(node.value)
        spec = node.format_spec.values[0].value if node.format_spec and len(node.format_spec.values) == 1 and isinstance(node.format_spec.values[0], ast.Constant) else "" if node.format_spec is None else None
        if node.conversion != -1 or spec is None:
            raise self.refuse(node, "no such format")
        if not spec:
            return _text(value)
        digits = spec.removesuffix("d").removeprefix("0")
        if value.kind != "num" or not spec.startswith("0") or not digits.isdigit() or int(digits) > MAX_PAD:
            raise self.refuse(node, f"no format {spec!r}")
        whole = value.column.cast("bigint").cast("string")
        return F.when(F.length(whole) < int(digits), F.lpad(whole, int(digits), "0")).otherwise(whole)

    def _Call(self, node: ast.Call) -> Value:
        if node.keywords:
            raise self.refuse(node, "no named arguments")
        if isinstance(node.func, ast.Name):
            return self._function(node, node.func.id)
        if not isinstance(node.func, ast.Attribute):
            raise self.refuse(node, "no such call")
        if node.func.attr == "get" and isinstance(node.func.value, ast.Dict):
            return self._lookup(node, node.func.value)
        if node.func.attr not in METHODS:
            raise self.refuse(node, f"no method {node.func.attr}")
        kinds, kind, made = METHODS[node.func.attr]
        if len(kinds) != len(node.args):
            raise self.refuse(node, f"{node.func.attr} takes {len(kinds)} arguments")
        return Value(made(self.of_kind(node.func.value, "str"), *map(self.of_kind, node.args, kinds)), kind)

    def _function(self, node: ast.Call, name: str) -> Value:
        if name in ("min", "max") and len(node.args) > 1:
            columns, kind = self.alike(node, *node.args)
            return Value((F.least if name == "min" else F.greatest)(*columns), kind)
        if len(node.args) != 1:
            raise self.refuse(node, f"no function {name} of {len(node.args)} arguments")
        if name == "str":
            return Value(_text(self.value(node.args[0])), "str")
        if name == "int":
            return Value(self.of_kind(node.args[0], "num").cast("bigint"), "num")
        if name not in FUNCTIONS:
            raise self.refuse(node, f"no function {name}")
        taken, kind, made = FUNCTIONS[name]
        return Value(made(self.of_kind(node.args[0], taken)), kind)

    def _lookup(self, node: ast.Call, table: ast.Dict) -> Value:
        if not 1 <= len(node.args) <= 2:
            raise self.refuse(node, "get takes a key and a value for others")
        asked = self.value(node.args[0])
        values, kind = self.alike(node, *table.values, *node.args[1:])
        found = values[len(table.values)] if len(node.args) == 2 else F.lit(None)
        for key, value in reversed(list(zip(table.keys, values, strict=False))):
            if key is None or self.value(key).kind != asked.kind:
                raise self.refuse(node, "keys of a table are of the kind that is looked up")
            found = F.when(asked.column == self.value(key).column, value).otherwise(found)
        return Value(found, kind)


def read_script(name: str, text: str) -> dict[str, Key]:
    """The keys that a script registers, by name; ScriptError names the script and the line."""
    if len(text) > MAX_CHARS:
        raise ScriptError(f"{name}: more than {MAX_CHARS} characters")
    try:
        tree = ast.parse(text, name)
        nodes = sum(1 for _ in ast.walk(tree))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        raise ScriptError(f"{name}: {error}") from error
    if nodes > MAX_NODES:
        raise ScriptError(f"{name}: more than {MAX_NODES} parts")
    keys: dict[str, Key] = {}
    for i, statement in enumerate(tree.body):
        call = statement.value if isinstance(statement, ast.Expr) else None
        if i == 0 and isinstance(call, ast.Constant) and isinstance(call.value, str):
            continue
        where = f"{name}:{statement.lineno}"
        if not (isinstance(call, ast.Call) and isinstance(call.func, ast.Name) and call.func.id == "register_sort" and len(call.args) == 2 and not call.keywords):
            raise ScriptError(f'{where}: only register_sort("name", lambda item: expression) is allowed')
        label, key = call.args
        if not (isinstance(label, ast.Constant) and isinstance(label.value, str) and label.value.strip()):
            raise ScriptError(f"{where}: an order needs a name")
        plain = isinstance(key, ast.Lambda) and len(key.args.args) == 1 and not (key.args.posonlyargs or key.args.kwonlyargs or key.args.vararg or key.args.kwarg or key.args.defaults)
        if not plain:
            raise ScriptError(f"{where}: a key is a lambda of one item")
        keys[label.value] = Key(name, key.body, key.args.args[0].arg)
    return keys

"""Column expressions put together as SQL text, with the names of pyspark.sql.functions.

A rule set makes expressions of thousands of nodes. As text they cost nothing to put together and one call to parse;
`column()` turns the text into a Column.
"""

from __future__ import annotations

import inspect
from itertools import count

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as _F

_names = count()
_COLUMNS_ONLY = {"least", "greatest", "coalesce", "array", "concat"}


class Column:
    """A piece of SQL."""

    def __init__(self, text: str, name: str | None = None):
        self.text, self.name = text, name

    def alias(self, name: str) -> Column:
        return Column(self.text, name)

    def __getitem__(self, field: str) -> Column:
        return Column(f"{self.text}.`{field}`")

    def _two(self, sign: str, other, swap: bool = False) -> Column:
        a, b = self.text, lit(other).text
        return Column(f"({b} {sign} {a})" if swap else f"({a} {sign} {b})")

    def __add__(self, o): return self._two("+", o)  # noqa: E704
    def __radd__(self, o): return self._two("+", o, True)  # noqa: E704
    def __sub__(self, o): return self._two("-", o)  # noqa: E704
    def __rsub__(self, o): return self._two("-", o, True)  # noqa: E704
    def __mul__(self, o): return self._two("*", o)  # noqa: E704
    def __rmul__(self, o): return self._two("*", o, True)  # noqa: E704
    def __truediv__(self, o): return self._two("/", o)  # noqa: E704
    def __mod__(self, o): return self._two("%", o)  # noqa: E704
    def __eq__(self, o): return self._two("=", o)  # noqa: E704
    def __ne__(self, o): return self._two("<>", o)  # noqa: E704
    def __lt__(self, o): return self._two("<", o)  # noqa: E704
    def __le__(self, o): return self._two("<=", o)  # noqa: E704
    def __gt__(self, o): return self._two(">", o)  # noqa: E704
    def __ge__(self, o): return self._two(">=", o)  # noqa: E704
    def __and__(self, o): return self._two("AND", o)  # noqa: E704
    def __or__(self, o): return self._two("OR", o)  # noqa: E704
    def __invert__(self): return Column(f"(NOT {self.text})")  # noqa: E704
    def __neg__(self): return Column(f"(- {self.text})")  # noqa: E704

    __hash__ = None

    def __bool__(self):
        raise ValueError("an expression has no truth value; use &, | and ~")

    def isNull(self): return Column(f"({self.text} IS NULL)")  # noqa: E704, N802
    def isNotNull(self): return Column(f"({self.text} IS NOT NULL)")  # noqa: E704, N802
    def cast(self, kind: str): return Column(f"CAST({self.text} AS {kind})")  # noqa: E704
    def try_cast(self, kind: str): return Column(f"TRY_CAST({self.text} AS {kind})")  # noqa: E704
    def contains(self, o): return Column(f"contains({self.text}, {lit(o).text})")  # noqa: E704
    def startswith(self, o): return Column(f"startswith({self.text}, {lit(o).text})")  # noqa: E704
    def rlike(self, o): return Column(f"rlike({self.text}, {lit(o).text})")  # noqa: E704
    def between(self, a, b): return (self >= a) & (self <= b)  # noqa: E704

    def isin(self, *values) -> Column:
        values = values[0] if len(values) == 1 and isinstance(values[0], list | tuple | set) else values
        return Column(f"({self.text} IN ({', '.join(lit(v).text for v in values)}))")


class Case(Column):
    def __init__(self, branches: list[tuple[Column, Column]], last: Column | None = None):
        self.branches, self.last, self.name = branches, last, None

    @property
    def text(self) -> str:
        parts = " ".join(f"WHEN {c.text} THEN {v.text}" for c, v in self.branches)
        return f"(CASE {parts}{'' if self.last is None else f' ELSE {self.last.text}'} END)"

    def when(self, condition, value) -> Case:
        return Case([*self.branches, (lit(condition), lit(value))])

    def otherwise(self, value) -> Case:
        return Case(self.branches, lit(value))


def when(condition, value) -> Case:
    return Case([(lit(condition), lit(value))])


def lit(x) -> Column:
    if isinstance(x, Column):
        return x
    if x is None:
        return Column("NULL")
    if isinstance(x, bool):
        return Column(str(x).lower())
    if isinstance(x, int):
        return Column(str(x) if abs(x) < 1 << 31 else f"{x}L")
    if isinstance(x, float):
        return Column(f"{x!r}D")
    return Column("'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + "'")


def col(name: str) -> Column:
    return Column(f"`{name}`")


def expr(text: str) -> Column:
    return Column(text)


def struct(*fields: Column) -> Column:
    return Column("named_struct(" + ", ".join(f"'{f.name}', {f.text}" for f in fields) + ")")


def _arg(x, place: int, function: str) -> str:
    if callable(x) and not isinstance(x, Column):
        variables = [f"_x{next(_names)}" for _ in inspect.signature(x).parameters]
        body = lit(x(*map(Column, variables))).text
        return f"({', '.join(variables)}) -> {body}" if len(variables) > 1 else f"{variables[0]} -> {body}"
    if isinstance(x, str) and (place == 0 or function in _COLUMNS_ONLY):
        return f"`{x}`"
    return lit(x).text


def __getattr__(function: str):
    if function.startswith("__"):
        raise AttributeError(function)

    def call(*args) -> Column:
        return Column(f"{function}({', '.join(_arg(x, k, function) for k, x in enumerate(args))})")

    return call


def column(x: Column) -> SparkColumn:
    """As a Column of Spark."""
    made = _F.expr(x.text)
    return made.alias(x.name) if x.name else made


def with_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns, in a projection of their own: Spark keeps it apart from later ones that use a costly column more than once."""
    return df.withColumns({k: column(v.alias(k)) for k, v in columns.items()})


def select(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.select(*(c if isinstance(c, str) else column(c) for c in columns))

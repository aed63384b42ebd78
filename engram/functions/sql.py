"""Spark SQL expressions as text.

The fact rules are large expressions.  Building them with ``pyspark.sql.functions``
costs a gateway call per node (seconds per query); as text they are parsed once by
``selectExpr``.  Names follow ``pyspark.sql.functions``; a plain Python value is a
literal, a column is ``col("name")``.
"""

from __future__ import annotations

from itertools import count

_fresh = count()


class Expr:
    """SQL text with the operators of a column."""

    def __init__(self, sql: str):
        self.sql = sql

    def __str__(self) -> str:
        return self.sql

    def _binary(self, op: str, other) -> "Expr":
        return Expr(f"({self} {op} {lit(other)})")

    def __and__(self, other): return self._binary("AND", other)
    def __or__(self, other): return self._binary("OR", other)
    def __invert__(self): return Expr(f"(NOT {self})")
    def __eq__(self, other): return self._binary("=", other)
    def __ne__(self, other): return self._binary("<>", other)
    def __lt__(self, other): return self._binary("<", other)
    def __le__(self, other): return self._binary("<=", other)
    def __gt__(self, other): return self._binary(">", other)
    def __ge__(self, other): return self._binary(">=", other)
    def __add__(self, other): return self._binary("+", other)
    def __sub__(self, other): return self._binary("-", other)
    def __mul__(self, other): return self._binary("*", other)
    def __truediv__(self, other): return self._binary("/", other)
    def __neg__(self): return Expr(f"(- {self})")
    def __getitem__(self, field: str): return Expr(f"{self}.`{field}`")
    __hash__ = object.__hash__

    def isin(self, *values): return Expr(f"({self} IN ({', '.join(str(lit(v)) for v in values)}))")
    def rlike(self, pattern): return Expr(f"rlike({self}, {lit(pattern)})")
    def contains(self, part): return Expr(f"contains({self}, {lit(part)})")
    def startswith(self, part): return Expr(f"startswith({self}, {lit(part)})")
    def endswith(self, part): return Expr(f"endswith({self}, {lit(part)})")
    def isNull(self): return Expr(f"({self} IS NULL)")
    def isNotNull(self): return Expr(f"({self} IS NOT NULL)")
    def cast(self, kind): return Expr(f"CAST({self} AS {kind})")
    def alias(self, name): return Expr(f"{self} AS `{name}`")


class Case(Expr):
    """CASE WHEN under construction."""

    def __init__(self, branches):
        self.branches = branches
        super().__init__("CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + " END")

    def when(self, condition, value): return Case([*self.branches, (condition, lit(value))])

    def otherwise(self, value): return Expr(self.sql[:-4] + f" ELSE {lit(value)} END")


def lit(value) -> Expr:
    if isinstance(value, Expr):
        return value
    if value is None:
        return Expr("NULL")
    if isinstance(value, bool):
        return Expr(str(value).lower())
    if isinstance(value, float):
        return Expr(f"{value!r}D")
    if isinstance(value, int):
        return Expr(str(value))
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return Expr(f"'{escaped}'")


def col(name: str) -> Expr:
    return Expr(f"`{name}`")


def when(condition, value) -> Case:
    return Case([(condition, lit(value))])


def call(name: str, *args) -> Expr:
    return Expr(f"{name}({', '.join(str(lit(a)) for a in args)})")


def lambda_call(name: str, array, body, *, arity: int = 1, extra=()) -> Expr:
    names = [f"x{next(_fresh)}" for _ in range(arity)]
    inner = body(*[Expr(n) for n in names])
    head = names[0] if arity == 1 else f"({', '.join(names)})"
    parts = [str(lit(array)), *[str(lit(e)) for e in extra], f"{head} -> {lit(inner)}"]
    return Expr(f"{name}({', '.join(parts)})")


def transform(array, body):
    return lambda_call("transform", array, body, arity=body.__code__.co_argcount
                       if hasattr(body, "__code__") else 1)


def filter(array, body): return lambda_call("filter", array, body)  # noqa: A001
def exists(array, body): return lambda_call("exists", array, body)
def forall(array, body): return lambda_call("forall", array, body)


def aggregate(array, start, merge):
    return lambda_call("aggregate", array, merge, arity=2, extra=(start,))


def let(value, body) -> Expr:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return Expr(f"element_at({lambda_call('transform', array_of([value]), body)}, 1)")


def struct(*fields): return call("struct", *fields)
def array_of(values): return call("array", *values)
def create_map(*pairs): return call("map", *pairs)


def __getattr__(name: str):
    """Any other SQL function by name, e.g. ``lower(x)``."""
    if name.startswith("_"):
        raise AttributeError(name)
    return lambda *args: call(name, *args)

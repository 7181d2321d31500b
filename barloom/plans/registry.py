"""Named queries: a Spark plan, the SQL that must give the same table, and one column spec for both.

Spec: `name:kind` items; f = double to 6 places, l = signed log of 1 + size (for figures that compound), d = date as text, t = timestamp as text, i = bigint,
s = text, b = boolean."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.sources.tables import Tables

# Prices in cents over whole quantities often end exactly half-way between two sixth decimals, where
# engines round either way. The same small shift on both sides moves them off the tie.
NUDGE = 1.3e-8

QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str]] = {}
SQL: dict[str, str] = {}


def _kinds(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in spec.split()]


def _show(name: str, kind: str) -> Column:
    c = F.col(name)
    made = {"f": lambda: F.round(c.cast("double") + NUDGE, 6) + F.lit(0.0), "i": lambda: c.cast("bigint"),
            "l": lambda: F.round(F.signum(c) * F.ln(F.abs(c.cast("double")) + 1) + NUDGE, 6) + F.lit(0.0),
            "d": lambda: c.cast("date").cast("string"), "s": lambda: c.cast("string"),
            "t": lambda: F.date_format(c, "yyyy-MM-dd HH:mm:ss"), "b": lambda: c.cast("boolean")}[kind]()
    return made.alias(name)


def _show_sql(name: str, kind: str) -> str:
    return {"f": f"round(cast({name} as double) + {NUDGE!r}, 6) + 0.0", "i": f"cast({name} as bigint)",
            "l": f"round(sign({name}) * ln(abs(cast({name} as double)) + 1) + {NUDGE!r}, 6) + 0.0",
            "d": f"cast(cast({name} as date) as varchar)", "s": f"cast({name} as varchar)",
            "t": f"strftime({name}, '%Y-%m-%d %H:%M:%S')",
            "b": f"cast({name} as boolean)"}[kind] + f" as {name}"


def query(name: str, spec: str, sql: str | None = None):
    """Registers `fn(tables) -> DataFrame`. `sql` is the full statement giving the same columns."""
    def keep(fn):
        QUERIES[name] = (fn, spec)
        if sql is not None:
            SQL[name] = "select " + ", ".join(_show_sql(n, k) for n, k in _kinds(spec)) + f" from ({sql}) as q_"
        return fn
    return keep


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    fn, spec = QUERIES[name]
    return fn(Tables(spark, folder)).select(*[_show(n, k) for n, k in _kinds(spec)])


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, folder, n=n: run(n, spark, folder)) for n in QUERIES}

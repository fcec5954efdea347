"""Helpers to write the queries' SQL: the market tables as common table expressions, frames and rounding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def bars_sql(unit: str = "hour") -> str:
    return f"""bars AS (SELECT event_type AS symbol, date_trunc('{unit}', ts) AS ts, min_by(value, ts) AS open, max(value) AS high, min(value) AS low,
  max_by(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"""


TRADES_SQL = """trades AS (SELECT l_returnflag AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_quantity AS quantity,
  CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side FROM lineitem)"""
BOOK_SQL = """book AS (SELECT l_returnflag AS symbol, l_shipdate AS ts, CASE WHEN l_linestatus = 'O' THEN 'bid' ELSE 'ask' END AS side,
  l_extendedprice / l_quantity AS price, l_quantity AS size, l_linenumber - 1 AS level FROM lineitem)"""
RETURNS_SQL = """er AS (SELECT symbol, bar, seq, r FROM (SELECT event_type AS symbol, date_trunc('day', ts) AS bar,
    row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts) - 1 AS seq,
    ln(value / lag(value) OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts)) AS r FROM events) WHERE r IS NOT NULL)"""
W = "(PARTITION BY symbol ORDER BY ts)"


def frame(a: str, b: str = "CURRENT ROW") -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {a} AND {b})"


def last(n: int) -> str:
    return frame(f"{n - 1} PRECEDING")


def roll(f: str, x: str, n: int) -> str:
    """f over the last n values, null until there are n."""
    return f"(CASE WHEN count({x}) OVER {last(n)} = {n} THEN {f}({x}) OVER {last(n)} END)"


def lag(x: str, k: int = 1) -> str:
    return f"(lag({x}, {k}) OVER {W})"


def r(x: str, name: str) -> str:
    return f"round({x}, {DIGITS}) + 0.0 AS {name}"


def with_bars(*steps: str, unit: str = "hour") -> str:
    """The bars, then each step as a table t1, t2, ...; the last step is the query itself. A step reads its predecessor as prev."""
    names = ["bars", *[f"t{i + 1}" for i in range(len(steps) - 1)]]
    ctes = [bars_sql(unit), *[f"{n} AS ({s.replace('prev', p)})" for n, s, p in zip(names[1:], steps[:-1], names, strict=False)]]
    return "WITH " + ",\n".join(ctes) + "\n" + steps[-1].replace("prev", names[-1])


def values(source: str, columns: dict[str, str], keep: str = "symbol, ts") -> str:
    """A final SELECT of rounded values, without rows in which one is missing."""
    inner = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    return f"SELECT {keep}, {', '.join(r(k, k) for k in columns)} FROM (SELECT {keep}, {inner} FROM {source}) WHERE {' AND '.join(f'{k} IS NOT NULL' for k in columns)}"


def rounded(df: DataFrame) -> DataFrame:
    """All double columns to DIGITS places, without a negative zero."""
    return df.select(*[(F.round(f.name, DIGITS) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])

"""Helpers shared by the catalog modules: table loading and SQL snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

#: Tables whose rows are worked on one by one for long: small files of them are dealt out first.
SPREAD = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in SPREAD else df


def lit(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rx_sub(x: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(repl)}, 'g')"


WS_EDGES = r"^\s+|\s+$"


def strip_ws(x: str) -> str:
    return rx_sub(x, WS_EDGES)


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def word_count(x: str) -> str:
    return f"len({words(x)})::BIGINT"


def round6(x: str, d: int = 6) -> str:
    return (f"(CASE WHEN abs({x}) < {2.0 ** 52 / 10 ** d} THEN floor(({x}) * {float(10 ** d)} + 0.5) / {float(10 ** d)} "
            f"ELSE {x} END)::DOUBLE")


def values(rows, cols, alias: str = "t") -> str:
    """VALUES table literal."""
    def v(x):
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "TRUE" if x else "FALSE"
        if isinstance(x, (int, float)):
            return repr(float(x)) if isinstance(x, float) else str(x)
        return lit(x)
    body = ", ".join("(" + ", ".join(v(x) for x in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({', '.join(cols)})"

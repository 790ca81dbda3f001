"""Registering queries, and SQL fragments shared by their oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from pagewright.functions.text import WHITE_SPACE
from pagewright.plans.ship import ship_package
from pagewright.plans.spread import spread

#: Tables whose rows take real work each, so that idle task slots cost time.
_TEXT_HEAVY = {"documents", "pages"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL if there is one."""

    def register(function):
        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return function(spark, sf_dir)

        QUERIES[function.__name__] = run
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(rows) if name in _TEXT_HEAVY else rows


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WS = quote(WHITE_SPACE)


def sql_strip(expression: str) -> str:
    return f"trim({expression}, {_WS})"


def sql_collapse(expression: str) -> str:
    return sql_strip(f"regexp_replace({expression}, '[\\s\\x{{a0}}\\x{{2028}}\\x{{3000}}]+', ' ', 'g')")


#: Sentences of a text: after end punctuation or at blank lines.
def sql_sentences(expression: str) -> str:
    marked = (
        f"regexp_replace(regexp_replace({expression}, '\\n\\s*\\n', chr(1), 'g'), "
        "'([.!?…:;])\\s+', '\\1' || chr(1), 'g')"
    )
    pieces = f"list_transform(string_split({marked}, chr(1)), lambda x: {sql_collapse('x')})"
    return f"list_filter({pieces}, lambda x: x <> '')"


WORD = "[\\p{L}\\p{N}\\p{M}_]"

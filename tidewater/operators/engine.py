"""A session with statements: run SQL, prepare it, build it, and fetch its rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidewater.functions.errors import MissingParameter, converted
from tidewater.functions.params import Params, Types, compile_sql
from tidewater.operators import result, tables
from tidewater.operators.builder import QueryBuilder

#: Functions over a result that engines and bound builders have as methods.
FETCHES = (
    "fetch_associative", "fetch_numeric", "fetch_one", "fetch_all_associative", "fetch_all_numeric", "fetch_first_column", "fetch_all_key_value", "fetch_all_associative_indexed",
    "iterate_associative", "iterate_numeric", "iterate_column", "iterate_key_value", "iterate_associative_indexed",
)


class Statement:
    """SQL whose values are bound one by one; positions count from 1."""

    def __init__(self, engine: Engine, sql: str) -> None:
        self._engine, self._sql = engine, sql
        self._values: dict[int | str, Any] = {}
        self._kinds: dict[int | str, str] = {}

    def bind_value(self, key: int | str, value: Any, kind: str | None = None) -> Statement:
        if isinstance(key, int) and key < 1:
            raise MissingParameter(f"positions count from 1, not {key}")
        key = key.lstrip(":") if isinstance(key, str) else key
        self._values[key] = value
        if kind is not None:
            self._kinds[key] = kind
        return self

    def _bound(self) -> tuple[Params, Types]:
        if any(isinstance(k, str) for k in self._values):
            return {k: v for k, v in self._values.items() if isinstance(k, str)}, {k: v for k, v in self._kinds.items() if isinstance(k, str)}
        last = max(self._values, default=0)
        if missing := [i for i in range(1, last + 1) if i not in self._values]:
            raise MissingParameter(f"no value for parameter {missing[0]}")
        return [self._values[i] for i in range(1, last + 1)], {i - 1: v for i, v in self._kinds.items()}

    def execute_query(self) -> DataFrame:
        return self._engine.execute_query(self._sql, *self._bound())

    def execute_statement(self) -> int:
        return self._engine.execute_statement(self._sql, *self._bound())


class BoundBuilder(QueryBuilder):
    """A query builder that knows its engine."""

    def __init__(self, engine: Engine) -> None:
        super().__init__()
        self._engine = engine

    def execute_query(self) -> DataFrame:
        return self.to_df(self._engine.spark)

    def execute_statement(self) -> int:
        return self.apply(self._engine.spark)


class Engine:
    """Runs SQL text or builders in a Spark session; results are lazy DataFrames."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def execute_query(self, query: str | QueryBuilder, params: Params = (), types: Types = ()) -> DataFrame:
        if isinstance(query, QueryBuilder):
            return query.to_df(self.spark)
        text, args = compile_sql(query, params, types)
        with converted():
            return self.spark.sql(text, args=args)

    def execute_statement(self, query: str | QueryBuilder, params: Params = (), types: Types = ()) -> int:
        """Run a statement at once. A builder's change gives the number of rows it changed;
        Spark doesn't tell it for SQL text, which gives 0."""
        if isinstance(query, QueryBuilder):
            return query.apply(self.spark)
        self.execute_query(query, params, types).collect()
        return 0

    def prepare(self, sql: str) -> Statement:
        return Statement(self, sql)

    def query_builder(self) -> BoundBuilder:
        return BoundBuilder(self)

    def insert(self, table: str, values: dict[str, Any]) -> int:
        return tables.insert(self.spark, table, values)

    def update(self, table: str, values: dict[str, Any], criteria: dict[str, Any], everything: bool = False) -> int:
        return tables.update(self.spark, table, values, criteria, everything)

    def delete(self, table: str, criteria: dict[str, Any], everything: bool = False) -> int:
        return tables.delete(self.spark, table, criteria, everything)


def _fetching(fetch: Callable[[DataFrame], Any], bound: bool) -> Callable[..., Any]:
    if bound:
        return lambda self: fetch(self.execute_query())
    return lambda self, query, params=(), types=(): fetch(self.execute_query(query, params, types))


for _name in FETCHES:
    setattr(Engine, _name, _fetching(getattr(result, _name), False))
    setattr(BoundBuilder, _name, _fetching(getattr(result, _name), True))

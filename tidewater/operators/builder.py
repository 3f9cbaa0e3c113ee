"""A composable query: clauses are collected, then become one Spark SQL statement.

Slots take any Spark SQL expression, so aggregates, windows and subqueries are at
hand in all of them. Nothing runs before an action on the DataFrame of to_df.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidewater.functions.errors import NotSupported, QueryError, converted
from tidewater.functions.exprs import Composite, and_, or_
from tidewater.functions.params import compile_sql
from tidewater.operators import tables

#: Stands between expressions that are bound together.
_CUT = " /* ; */ "


@dataclass(frozen=True)
class Join:
    kind: str
    table: str
    alias: str
    condition: str | None


def _sourced(table: str, alias: str | None) -> str:
    return table if alias is None or alias == table else f"{table} {alias}"


def _widened(kind: str, before: Composite | str | None, parts: tuple[object, ...]) -> Composite:
    """The predicate with more parts: a composite of the kind grows, any other is wrapped."""
    if before is None:
        return Composite(kind, tuple(map(str, parts)))
    if isinstance(before, Composite) and before.kind == kind:
        return before.with_(*parts)
    return Composite(kind, (str(before), *map(str, parts)))


class QueryBuilder:
    """Methods change the builder and return it. Parameters belong to the outermost builder."""

    def __init__(self) -> None:
        self._columns: list[str] = []
        self._distinct = False
        self._from: list[tuple[str, str | None]] = []
        self._joins: dict[str, list[Join]] = {}
        self._where: Composite | None = None
        self._having: Composite | None = None
        self._group: list[str] = []
        self._order: list[str] = []
        self._limit: int | None = None
        self._offset = 0
        self._ctes: list[tuple[str, str, tuple[str, ...] | None]] = []
        self._parts: list[tuple[str, str]] = []
        self._is_union = False
        self._positional: list[Any] = []
        self._named: dict[str, Any] = {}
        self._types: dict[int | str, str] = {}
        self._made = 0
        self._change: tuple[str, str] | None = None
        self._set: dict[str, str] = {}
        self._source: str | None = None

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(self._columns)

    @property
    def is_distinct(self) -> bool:
        return self._distinct

    @property
    def sources(self) -> tuple[tuple[str, str | None], ...]:
        return tuple(self._from)

    @property
    def joins(self) -> tuple[tuple[str, Join], ...]:
        """(alias joined from, join) in the order they were added to each alias."""
        return tuple((alias, j) for alias, some in self._joins.items() for j in some)

    @property
    def predicate(self) -> str | None:
        return None if self._where is None else str(self._where)

    @property
    def group_predicate(self) -> str | None:
        return None if self._having is None else str(self._having)

    @property
    def group_keys(self) -> tuple[str, ...]:
        return tuple(self._group)

    @property
    def order_keys(self) -> tuple[str, ...]:
        return tuple(self._order)

    @property
    def limits(self) -> tuple[int | None, int]:
        """Most rows (None: all) and the first row."""
        return self._limit, self._offset

    @property
    def union_parts(self) -> tuple[tuple[str, str], ...]:
        """(how the part is added, the part)"""
        return tuple(self._parts)

    @property
    def change(self) -> tuple[str, str] | None:
        """(INSERT, UPDATE or DELETE, table), or None for a select or a union."""
        return self._change

    @property
    def assignments(self) -> dict[str, str]:
        """Columns and the expressions that an insert or update gives them."""
        return dict(self._set)

    def _changes(self, kind: str, table: str) -> QueryBuilder:
        self._change = (kind, table)
        return self

    def insert(self, table: str) -> QueryBuilder:
        return self._changes("INSERT", table)

    def update(self, table: str) -> QueryBuilder:
        return self._changes("UPDATE", table)

    def delete(self, table: str) -> QueryBuilder:
        return self._changes("DELETE", table)

    def values(self, values: dict[str, str]) -> QueryBuilder:
        """The columns of an insert or update and their expressions, instead of those so far."""
        self._set = dict(values)
        return self

    def set(self, column: str, value: str) -> QueryBuilder:
        self._set[column] = value
        return self

    set_value = set

    def _with_data(self, kind: str, table: str, data: dict[str, Any], named: bool) -> QueryBuilder:
        if not data:
            raise QueryError(f"an {kind.lower()} needs values")
        self._changes(kind, table)
        for column, value in data.items():
            self.set(column, self.create_named_parameter(value, name=column) if named else self.create_positional_parameter(value))
        return self

    def insert_with(self, table: str, data: dict[str, Any], named: bool = False) -> QueryBuilder:
        """An insert of one row whose values are bound, by position or by their column's name."""
        return self._with_data("INSERT", table, data, named)

    def update_with(self, table: str, data: dict[str, Any], named: bool = False) -> QueryBuilder:
        return self._with_data("UPDATE", table, data, named)

    def insert_from(self, table: str, columns: tuple[str, ...], part: object) -> QueryBuilder:
        """An insert of all rows of a query."""
        self._set, self._source = dict.fromkeys(columns, ""), str(part)
        return self._changes("INSERT", table)

    def sub(self) -> QueryBuilder:
        """A fresh builder; its parameters have to be created on this one."""
        return QueryBuilder()

    def select(self, *columns: str) -> QueryBuilder:
        self._columns, self._is_union = list(columns), False
        return self

    def add_select(self, *columns: str) -> QueryBuilder:
        self._columns += columns
        return self

    def distinct(self, flag: bool = True) -> QueryBuilder:
        self._distinct = flag
        return self

    def from_(self, table: str, alias: str | None = None) -> QueryBuilder:
        self._from.append((table, alias))
        return self

    def _join(self, kind: str, from_alias: str, table: str, alias: str, condition: object) -> QueryBuilder:
        self._joins.setdefault(from_alias, []).append(Join(kind, table, alias, None if condition is None else str(condition)))
        return self

    def inner_join(self, from_alias: str, table: str, alias: str, condition: object = None) -> QueryBuilder:
        """Without a condition all rows of both sides meet."""
        return self._join("INNER", from_alias, table, alias, condition)

    join = inner_join

    def left_join(self, from_alias: str, table: str, alias: str, condition: object = None) -> QueryBuilder:
        return self._join("LEFT", from_alias, table, alias, condition)

    def right_join(self, from_alias: str, table: str, alias: str, condition: object = None) -> QueryBuilder:
        return self._join("RIGHT", from_alias, table, alias, condition)

    def where(self, first: object, *more: object) -> QueryBuilder:
        self._where = and_(first, *more)
        return self

    def and_where(self, *parts: object) -> QueryBuilder:
        self._where = _widened("AND", self._where, parts)
        return self

    def or_where(self, *parts: object) -> QueryBuilder:
        """The whole predicate so far is the left side."""
        self._where = _widened("OR", self._where, parts)
        return self

    def group_by(self, *keys: str) -> QueryBuilder:
        self._group = list(keys)
        return self

    def add_group_by(self, *keys: str) -> QueryBuilder:
        self._group += keys
        return self

    def having(self, first: object, *more: object) -> QueryBuilder:
        self._having = and_(first, *more)
        return self

    def and_having(self, *parts: object) -> QueryBuilder:
        self._having = _widened("AND", self._having, parts)
        return self

    def or_having(self, *parts: object) -> QueryBuilder:
        self._having = _widened("OR", self._having, parts)
        return self

    def order_by(self, key: str, direction: str | None = None) -> QueryBuilder:
        self._order = []
        return self.add_order_by(key, direction)

    def add_order_by(self, key: str, direction: str | None = None) -> QueryBuilder:
        self._order.append(key if direction is None else f"{key} {direction}")
        return self

    def set_max_results(self, rows: int | None) -> QueryBuilder:
        self._limit = rows
        return self

    def set_first_result(self, rows: int) -> QueryBuilder:
        if rows < 0:
            raise NotSupported(f"offset {rows} is below 0")
        self._offset = rows
        return self

    def reset_where(self) -> QueryBuilder:
        self._where = None
        return self

    def reset_group_by(self) -> QueryBuilder:
        self._group = []
        return self

    def reset_having(self) -> QueryBuilder:
        self._having = None
        return self

    def reset_order_by(self) -> QueryBuilder:
        self._order = []
        return self

    def with_(self, name: str, part: object, columns: tuple[str, ...] | None = None) -> QueryBuilder:
        if columns is not None and not columns:
            raise QueryError(f"the column list of {name} is empty")
        self._ctes.append((name, str(part), None if columns is None else tuple(columns)))
        return self

    def union(self, part: object) -> QueryBuilder:
        self._is_union, self._parts = True, [("", str(part))]
        return self

    def add_union(self, part: object, every: bool = False) -> QueryBuilder:
        """UNION, or with every UNION ALL, to all parts so far."""
        if not self._parts:
            raise QueryError("a union starts with union()")
        self._parts.append(("UNION ALL" if every else "UNION", str(part)))
        return self

    def for_update(self) -> QueryBuilder:
        raise NotSupported("Spark tables have no row locks")

    def set_parameter(self, key: int | str, value: Any, kind: str | None = None) -> QueryBuilder:
        """A number is a position from 0, a string a name; one sort drops the other."""
        if isinstance(key, int):
            self._named.clear()
            self._positional += [None] * (key + 1 - len(self._positional))
            self._positional[key] = value
        else:
            self._positional.clear()
            self._named[key] = value
        if kind is not None:
            self._types[key] = kind
        return self

    def set_parameters(self, values: list[Any] | dict[str, Any], kinds: dict[int | str, str] | None = None) -> QueryBuilder:
        self._positional, self._named = ([], dict(values)) if isinstance(values, dict) else (list(values), {})
        self._types = dict(kinds or {})
        return self

    def get_parameters(self) -> list[Any] | dict[str, Any]:
        return dict(self._named) if self._named else list(self._positional)

    def get_parameter(self, key: int | str) -> Any:
        return self._positional[key] if isinstance(key, int) else self._named[key]

    def get_parameter_type(self, key: int | str) -> str:
        return self._types.get(key, "string")

    def create_named_parameter(self, value: Any, kind: str | None = None, name: str | None = None) -> str:
        if name is None:
            self._made += 1
            while f"value{self._made}" in self._named:
                self._made += 1
            name = f"value{self._made}"
        self.set_parameter(name.lstrip(":"), value, kind)
        return f":{name.lstrip(':')}"

    def create_positional_parameter(self, value: Any, kind: str | None = None) -> str:
        self.set_parameter(len(self._positional), value, kind)
        return "?"

    def _check_aliases(self) -> None:
        """Every alias once, and joins only from known ones."""
        aliases = [alias or table for table, alias in self._from]
        aliases += [j.alias for joins in self._joins.values() for j in joins]
        for alias in aliases:
            if aliases.count(alias) > 1:
                raise QueryError(f"alias {alias} is used twice")
        for alias in self._joins:
            if alias not in aliases:
                raise QueryError(f"alias {alias} isn't known; known are {', '.join(aliases)}")

    def _joined(self, alias: str) -> str:
        """All joins of an alias, then those of each of the joined."""
        joins = self._joins.get(alias, [])
        text = "".join(f" {j.kind} JOIN {j.table} {j.alias}" + (f" ON {j.condition}" if j.condition else "") for j in joins)
        return text + "".join(self._joined(j.alias) for j in joins)

    def _tail(self) -> str:
        text = f" ORDER BY {', '.join(self._order)}" if self._order else ""
        text += f" LIMIT {self._limit}" if self._limit is not None else ""
        return text + (f" OFFSET {self._offset}" if self._offset else "")

    def _change_sql(self, kind: str, table: str) -> str:
        where = f" WHERE {self._where}" if self._where else ""
        if kind == "DELETE":
            return f"DELETE FROM {table}{where}"
        if not self._set:
            raise QueryError(f"an {kind.lower()} needs values")
        if kind == "UPDATE":
            return f"UPDATE {table} SET " + ", ".join(f"{c} = {v}" for c, v in self._set.items()) + where
        return f"INSERT INTO {table} ({', '.join(self._set)}) " + (self._source or f"VALUES ({', '.join(self._set.values())})")

    def to_sql(self) -> str:
        """The statement with its placeholders as they were written."""
        if self._change:
            return self._change_sql(*self._change)
        head = ", ".join(f"{name}{' (' + ', '.join(columns) + ')' if columns else ''} AS ({part})" for name, part, columns in self._ctes)
        head = f"WITH {head} " if head else ""
        if self._is_union:
            if len(self._parts) < 2:
                raise QueryError("a union has two parts at least")
            return head + " ".join(f"{kind} ({part})".lstrip() for kind, part in self._parts) + self._tail()
        if not self._columns:
            raise QueryError("the query selects no columns")
        self._check_aliases()
        text = f"{head}SELECT {'DISTINCT ' if self._distinct else ''}{', '.join(self._columns)}"
        if self._from:
            text += " FROM " + ", ".join(_sourced(table, alias) + self._joined(alias or table) for table, alias in self._from)
        text += f" WHERE {self._where}" if self._where else ""
        text += f" GROUP BY {', '.join(self._group)}" if self._group else ""
        return text + (f" HAVING {self._having}" if self._having else "") + self._tail()

    __str__ = to_sql

    def to_df(self, spark: SparkSession) -> DataFrame:
        """The lazy result, with all values bound by name."""
        if self._change:
            raise QueryError("a change has no rows; run it with apply()")
        text, args = compile_sql(self.to_sql(), self._named or self._positional, self._types)
        with converted():
            return spark.sql(text, args=args)

    def apply(self, spark: SparkSession) -> int:
        """Run an insert, update or delete; how many rows it has changed.

        Without a predicate an update or delete takes all rows.
        """
        if self._change is None:
            raise QueryError("only an insert, update or delete is applied")
        kind, table = self._change
        self.to_sql()
        given: Any = self._named or self._positional
        if kind == "INSERT":
            text, args = compile_sql(self._source or f"VALUES ({', '.join(self._set.values())})", given, self._types)
            with converted():
                return tables.insert_query(spark, table, list(self._set), spark.sql(text, args=args))
        # The values stand in the order of the whole text, so it is cut after they are bound.
        parts = [*(self._set.values() if kind == "UPDATE" else ()), *([str(self._where)] if self._where else [])]
        text, args = compile_sql(_CUT.join(parts), given, self._types)
        bound = text.split(_CUT) if parts else []
        where = bound.pop() if self._where else "true"
        return tables.change(spark, table, dict(zip(self._set, bound, strict=True)) if kind == "UPDATE" else None, where, args)

"""Compile-time model of a parser's extracted fields.

Fields whose names the pack declares are kept as single Column expressions, so Catalyst
prunes whatever a query does not read. Only formats with free field names (kv, json, xml,
cef and leef extensions) build a map column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT = "string"
_EMPTY_MAP = "map<string,string>"


def null_text() -> Column:
    return F.lit(None).cast(TEXT)


def empty_map() -> Column:
    return F.create_map().cast(_EMPTY_MAP)


@dataclass(frozen=True)
class Value:
    """A field value: its text (NULL = absent) and, once converted, the number behind it."""

    text: Column
    number: Column | None = None


class Stages:
    """Columns that several expressions share, added level by level.

    Each level is one projection; Catalyst keeps it apart only where a column is read
    more than once, so a shared regex or split runs once per row.
    """

    def __init__(self, prefix: str = "__x"):
        self.prefix = prefix
        self.levels: list[dict[str, Column]] = []
        self._n = 0

    def add(self, level: int, col: Column) -> Column:
        while len(self.levels) <= level:
            self.levels.append({})
        name = f"{self.prefix}{self._n}"
        self._n += 1
        self.levels[level][name] = col
        return F.col(name)

    def apply(self, df: DataFrame) -> DataFrame:
        for level in self.levels:
            df = df.withColumns(level)
        return df

    @property
    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]


@dataclass
class FieldSet:
    raw: Column
    stages: Stages
    guard: Column | None = None
    level: int = 0
    static: dict[str, Value] = field(default_factory=dict)
    dynamic: Column | None = None
    errors: list[Column] = field(default_factory=list)

    # --- staging -------------------------------------------------------------------
    def stage(self, col: Column) -> Column:
        """Materialise `col` once for the rows this parser owns."""
        if self.guard is not None:
            col = F.when(self.guard, col)
        out = self.stages.add(self.level, col)
        self.level += 1
        return out

    def clone(self) -> "FieldSet":
        return FieldSet(self.raw, self.stages, self.guard, self.level, dict(self.static), self.dynamic, list(self.errors))

    # --- reads ---------------------------------------------------------------------
    def get(self, name: str) -> Value:
        if name in self.static:
            return self.static[name]
        if self.dynamic is not None:
            return Value(self.dynamic[F.lit(name)])
        return Value(null_text())

    def text(self, name: str) -> Column:
        """Text of a field, "" when absent."""
        return F.coalesce(self.get(name).text, F.lit(""))

    def source(self, name: str | None) -> Column:
        return self.text(name) if name else self.raw

    # --- writes --------------------------------------------------------------------
    def set(self, name: str, value: Column, number: Column | None = None) -> None:
        """Set where `value` is not NULL; an earlier value stays otherwise."""
        if name in self.static or self.dynamic is not None:
            value = F.coalesce(value, self.get(name).text)
        self.static[name] = Value(value, number)

    def put(self, name: str, value: Value) -> None:
        """Replace outright, even by "absent"."""
        self.static[name] = value

    def drop(self, name: str) -> None:
        self.static[name] = Value(null_text())

    def merge_map(self, entries: Column) -> None:
        """Add a map of fields; its keys win over what is there."""
        for name, old in list(self.static.items()):
            self.static[name] = Value(F.coalesce(entries[F.lit(name)], old.text))
        if self.dynamic is None:
            self.dynamic = entries
        else:
            both = F.map_concat(F.coalesce(self.dynamic, empty_map()), F.coalesce(entries, empty_map()))
            self.dynamic = self.stage(both)

    def merge_overflow(self, entries: Column) -> None:
        """Add a rarely present map whose keys no pack names."""
        if self.dynamic is None:
            self.dynamic = entries
        else:
            self.dynamic = F.map_concat(F.coalesce(self.dynamic, empty_map()), F.coalesce(entries, empty_map()))

    def restore_where(self, failed: Column, before: "FieldSet") -> None:
        """Undo writes made since `before` on rows where `failed` is true."""
        for name in set(self.static) | set(before.static):
            now, old = self.get(name), before.get(name)
            if now is not old:
                self.static[name] = choose(failed, old, now)
        if self.dynamic is not before.dynamic:
            old_map = before.dynamic if before.dynamic is not None else empty_map()
            self.dynamic = F.when(failed, old_map).otherwise(self.dynamic)

    # --- results -------------------------------------------------------------------
    def to_map(self, skip: set[str] = frozenset()) -> Column:
        """All present fields except `skip`."""
        names = [n for n in self.static if n not in skip]
        fixed = None
        if names:
            pairs: list[Column] = []
            for n in names:
                pairs += [F.lit(n), self.static[n].text]
            fixed = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
        if self.dynamic is None:
            return fixed if fixed is not None else empty_map()
        hidden = sorted(set(self.static) | set(skip))
        free = F.map_filter(
            F.coalesce(self.dynamic, empty_map()),
            lambda k, v: v.isNotNull() & ~k.isin(hidden) if hidden else v.isNotNull(),
        )
        return F.map_concat(free, fixed) if fixed is not None else free

    def any_present(self) -> Column:
        found = F.lit(False)
        for value in self.static.values():
            found = found | value.text.isNotNull()
        if self.dynamic is not None:
            # a dropped name may still sit in the map, so look at the visible part only
            found = found | (F.size(self.to_map(skip=set(self.static))) > 0)
        return found

    def error_list(self) -> Column:
        if not self.errors:
            return F.array().cast("array<string>")
        return F.array_compact(F.array(*self.errors))

    def any_error(self) -> Column:
        bad = F.lit(False)
        for e in self.errors:
            bad = bad | e.isNotNull()
        return bad

    def status(self) -> Column:
        """ok, partial (an operator failed), or failed (and nothing was extracted)."""
        if not self.errors:
            return F.lit("ok")
        return F.when(~self.any_error(), F.lit("ok")).when(self.any_present(), F.lit("partial")).otherwise(F.lit("failed"))


def seal(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Give the named (default: all) columns fresh attributes by a one-row stack().

    Parsing shares intermediate columns over several projections. The optimizer pushes filters, and
    traces join keys, through projections by unfolding them, which for shared stages grows without
    bound. A generator ends that: what is above it sees plain columns.
    """
    names = names or df.columns
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.stack(F.lit(1), *[F.col(n) for n in names]).alias(*names))


def choose(cond: Column, a: Value, b: Value) -> Value:
    number = None
    if a.number is not None and b.number is not None:
        number = F.when(cond, a.number).otherwise(b.number)
    return Value(F.when(cond, a.text).otherwise(b.text), number)

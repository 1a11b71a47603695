"""Named indexes: explicit and implicit resolution, with the errors a caller relies on."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..types import IndexSpec
from .index import Index, build


@dataclass(frozen=True)
class Entry:
    index: Index
    table: str


class Registry:
    """Indexes by qualified name; unqualified names are looked up along the search path."""

    def __init__(self, search_path: tuple[str, ...] = ("public",)) -> None:
        self.search_path = search_path
        self.entries: dict[str, Entry] = {}

    def create(self, df: DataFrame, table: str, spec: IndexSpec) -> Index:
        name = spec.name if "." in spec.name else f"{self.search_path[0]}.{spec.name}"
        if name in self.entries:
            raise ValueError(f'relation "{spec.name}" already exists')
        index = build(df, spec)
        self.entries[name] = Entry(index, table)
        return index

    def drop(self, name: str) -> None:
        del self.entries[self.qualified(name)]

    def qualified(self, name: str) -> str:
        for full in [name] if "." in name else [f"{s}.{name}" for s in self.search_path]:
            if full in self.entries:
                return full
        raise ValueError(f'index "{name}" does not exist')

    def explicit(self, name: str, table: str | None = None, column: str | None = None) -> Index:
        entry = self.entries[self.qualified(name)]
        if column is not None and (entry.index.spec.column != column or (table is not None and entry.table != table)):
            raise ValueError(f'index "{name}" is not on column "{column}"')
        return entry.index

    def implicit(self, table: str, column: str) -> Index:
        """The first index made on the column; a warning if there are several, an error if there is none."""
        found = [(n, e) for n, e in self.entries.items() if e.table == table and e.index.spec.column == column]
        if not found:
            raise ValueError(f'no BM25 index on column "{column}" of "{table}"; create one, or name an index in the query')
        if len(found) > 1:
            warnings.warn(f'multiple BM25 indexes on column "{column}": using "{found[0][0]}"', stacklevel=2)
        return found[0][1].index

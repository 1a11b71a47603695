"""Index specifications, queries and document vectors, with their text forms."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

K1_RANGE, B_RANGE = (0.1, 10.0), (0.0, 1.0)


@dataclass(frozen=True)
class IndexSpec:
    """What an index covers: the text (or token) column, its analyzer, parameters and an optional tenant column."""

    name: str
    column: str
    text_config: str | None = None
    k1: float = 1.2
    b: float = 0.75
    id_column: str = "doc_id"
    tenant_column: str | None = None
    partition_column: str | None = None

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("index name must not be empty")
        if re.fullmatch(r"[A-Za-z_][\w.]*", self.column) is None:
            raise ValueError("BM25 indexes on expressions are not supported: name a column")
        if not K1_RANGE[0] <= self.k1 <= K1_RANGE[1]:
            raise ValueError(f"value {self.k1} out of bounds for option \"k1\": valid values are between {K1_RANGE[0]} and {K1_RANGE[1]}")
        if not B_RANGE[0] <= self.b <= B_RANGE[1]:
            raise ValueError(f"value {self.b} out of bounds for option \"b\": valid values are between {B_RANGE[0]} and {B_RANGE[1]}")


@dataclass(frozen=True)
class Bm25Query:
    """A query; equal if text and index are equal, whatever tenant or language."""

    text: str
    index: str | None = None
    language: str | None = field(default=None, compare=False)
    tenant_id: int | None = field(default=None, compare=False)

    @classmethod
    def parse(cls, literal: str, known: Any = ()) -> Bm25Query:
        """``text`` or ``index:text[:config]``; a prefix is an index only if that index is known."""
        head, colon, rest = literal.partition(":")
        if not colon:
            return cls(literal)
        if head not in known:
            raise ValueError(f'index "{head}" does not exist')
        text, colon, language = rest.rpartition(":")
        return cls(text, head, language) if colon else cls(rest, head)

    def __str__(self) -> str:
        return ":".join(x for x in (self.index, self.text, self.language if self.index else None) if x is not None)


@dataclass(frozen=True)
class Bm25Vector:
    """Term frequencies of one document under a named index; equality ignores the order of entries."""

    index: str
    entries: tuple[tuple[str, int], ...]

    def __post_init__(self) -> None:
        if not self.index:
            raise ValueError("bm25vector needs an index name")
        object.__setattr__(self, "entries", tuple(sorted(dict(self.entries).items())))

    @classmethod
    def parse(cls, literal: str) -> Bm25Vector:
        m = re.fullmatch(r"\s*([^:{}]*):\{(.*)\}\s*", literal, re.DOTALL)
        if m is None:
            raise ValueError(f'invalid input syntax for bm25vector: "{literal}"')
        entries = []
        for part in filter(None, (x.strip() for x in m[2].split(","))):
            term, colon, count = part.rpartition(":")
            if not colon or not count.strip().isdigit():
                raise ValueError(f'invalid entry in bm25vector: "{part}"')
            entries.append((term.strip(), int(count)))
        return cls(m[1].strip(), tuple(entries))

    def __str__(self) -> str:
        return f"{self.index}:{{{','.join(f'{t}:{n}' for t, n in self.entries)}}}"

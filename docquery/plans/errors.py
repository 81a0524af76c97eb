"""Errors of the grammars and of the store."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class ParseError(ValueError):
    """Where a query document is wrong. `unknown` marks words outside the vocabulary."""

    reason: str
    op: str = ""
    path: str = ""
    source: str = ""
    unknown: bool = False

    def __str__(self) -> str:
        return ": ".join(x for x in (self.source, self.path, self.reason) if x)

    def under(self, key: str) -> ParseError:
        self.path = f"{key}.{self.path}" if self.path else key
        return self


class UnsupportedTyped(TypeError):
    """The query needs values of several types in one field: use dynamic mode."""


class DocNotFound(KeyError): ...


class DocExists(ValueError): ...


class DocWithoutId(ValueError): ...


class UniqueViolation(ValueError): ...


class IndexMismatch(ValueError): ...


class PrimaryKeyError(ValueError): ...


class CollectionNotFound(KeyError): ...


class CollectionExists(ValueError): ...

"""The tree both query languages parse to."""

from __future__ import annotations

from dataclasses import dataclass, field

ANY_FIELD = "_ANYFIELD_"


class QuerySyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Compare:
    """``name`` is a field, or a call or method whose result is compared; ``value`` may be a Name or a tuple of values.

    Where either is an Arith the other may be one too, a Name or a number.
    """

    name: object
    op: str
    value: object


@dataclass(frozen=True)
class Method:
    """``FIELD.size() > 1`` and its like."""

    name: str
    method: str
    args: tuple
    op: str | None = None
    value: object = None


@dataclass(frozen=True)
class Call:
    space: str
    name: str
    args: tuple = field(default_factory=tuple)


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Arith:
    """A sum, difference, product, quotient or remainder; sides are numbers, Names or further ones."""

    op: str
    left: object
    right: object

    def names(self) -> set[str]:
        return {n for side in (self.left, self.right) for n in ({side.name} if isinstance(side, Name) else side.names() if isinstance(side, Arith) else ())}


@dataclass(frozen=True)
class Constant:
    value: bool

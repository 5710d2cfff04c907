"""Terms, patterns and statements of the query dialect."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Blank:
    """``_:name``, or a node written in brackets (``anonymous``)."""

    name: str
    anonymous: bool = False


@dataclass(frozen=True)
class Lit:
    """A literal: its text and whether it was written as a number."""

    value: str
    number: bool = False
    datatype: str | None = None


@dataclass(frozen=True)
class Var:
    name: str


Term = Iri | Blank | Lit | Var


@dataclass(frozen=True)
class Triple:
    s: Term
    p: Iri | Var
    o: Term


@dataclass(frozen=True)
class Filter:
    left: Term
    op: str
    right: Term


@dataclass(frozen=True)
class Count:
    var: str
    alias: str


@dataclass
class Select:
    items: list[Var | Count] | None  # None: all variables
    where: list[Triple]
    filters: list[Filter] = field(default_factory=list)
    order: list[tuple[str, bool]] = field(default_factory=list)  # name, ascending
    limit: int | None = None
    offset: int = 0
    variables: list[str] = field(default_factory=list)  # in order of first appearance


@dataclass
class Describe:
    iri: Iri | None
    names: list[str] | None
    select: Select | None


@dataclass
class Change:
    """Triples to delete, then triples to insert, for each solution of ``where`` (or once without one)."""

    delete: list[Triple]
    insert: list[Triple]
    where: Select | None


Statement = Select | Describe | list[Change]

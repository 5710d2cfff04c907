"""References to resources as Column expressions: white space, full, relative and prefixed spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace of the monitoring tables and its prefix.
MON = "http://monitor.example.org/#"
MON_PREFIX = "mon"


#: Fixed value: white space.
_SPACE = " \t\n\x0b\f\r"


def stripped(ref: Column) -> Column:
    """``ref`` without white space around it; null stays null."""
    return F.btrim(ref, F.lit(_SPACE))


def is_blank(ref: Column) -> Column:
    """True for null, empty or all white space; never null."""
    return ref.isNull() | (stripped(ref) == "")


def expand(ref: Column, ns: str = MON, prefix: str = MON_PREFIX, bare: bool = False) -> Column:
    """The full IRI of a reference: ``#x`` and ``prefix:x`` get the namespace, others stay.

    With ``bare`` a name that has none of ``: # /`` counts as a local name too (key columns are written so).
    Null gives null, blank gives null. Local names are case-sensitive.
    """
    s = stripped(ref)
    out = (
        F.when(s.startswith("#"), F.concat(F.lit(ns), F.substring(s, 2, 1_000_000)))
        .when(s.startswith(prefix + ":"), F.concat(F.lit(ns), F.substring(s, len(prefix) + 2, 1_000_000)))
    )
    if bare:
        out = out.when(~s.rlike("[:#/]"), F.concat(F.lit(ns), s))
    return F.when(s == "", F.lit(None).cast("string")).otherwise(out.otherwise(s))


def local_name(iri: Column, ns: str = MON) -> Column:
    """What follows the namespace; an IRI of another namespace stays whole."""
    return F.when(iri.startswith(ns), F.substring(iri, len(ns) + 1, 1_000_000)).otherwise(iri)


def local(ref: Column, ns: str = MON, prefix: str = MON_PREFIX) -> Column:
    """The local name of a reference in any spelling: ``local_name(expand(ref, bare=True))`` without the way round.

    An IRI of another namespace stays whole; null and blank give null.
    """
    s = stripped(ref)
    out = F.when(s == "", F.lit(None).cast("string"))
    for start in ("#", prefix + ":", ns):
        out = out.when(s.startswith(start), F.substring(s, len(start) + 1, 1_000_000))
    return out.otherwise(s)

"""Digests of XML documents."""

from __future__ import annotations

import hashlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical_digest(text: str | None) -> str | None:
    """MD5 of the canonical form of a document; None if it is not well-formed."""
    if text is None:
        return None
    try:
        return hashlib.md5(ElementTree.canonicalize(text, strip_text=True).encode()).hexdigest()
    except ElementTree.ParseError:
        return None


def _digests(s: pd.Series) -> pd.Series:
    return s.map(canonical_digest, na_action="ignore")


def xml_digest(text: Column) -> Column:
    """``canonical_digest`` of a column, batch by batch."""
    return F.pandas_udf(_digests, StringType())(text)


def signature_valid(text: Column, digest: Column) -> Column:
    """Whether a document has the given digest; false for what is not well-formed."""
    return F.coalesce(xml_digest(text) == F.lower(digest), F.lit(False))

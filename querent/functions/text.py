"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of anything but these separate terms.
TERM = "[^a-z0-9]+"


def tokens(text: Column | str) -> Column:
    """Lower-cased ASCII letter and digit runs; an empty array for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TERM), lambda t: t != "")


def chunks(text: Column | str, separator: str = "\\n\\n") -> Column:
    """The parts of a text between blank lines, without empty ones, as array of (chunk, text)."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), separator), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p, i: F.struct(i.alias("chunk"), p.alias("text")))


def mock_embedding(text: Column | str, dimension: int = 64) -> Column:
    """A unit vector from character codes, for tests without a model: code / 1000 is added to slot i modulo dimension."""
    t = F.col(text) if isinstance(text, str) else text
    codes = F.transform(F.filter(F.split(F.coalesce(t, F.lit("")), ""), lambda c: c != ""), lambda c: F.ascii(c) / 1000.0)
    slot = lambda s: F.aggregate(F.filter(codes, lambda c, i: i % dimension == s), F.lit(0.0), lambda acc, c: acc + c)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), slot)
    length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda acc, v: acc + v * v))
    return F.when(length > 0, F.transform(raw, lambda v: v / length)).otherwise(raw)


def mock_token_embeddings(text: Column | str, dimension: int = 64) -> Column:
    """``mock_embedding`` of every word."""
    return F.transform(tokens(text), lambda w: mock_embedding(w, dimension))

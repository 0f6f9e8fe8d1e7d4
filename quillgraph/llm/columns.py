"""Names of columns: quoting those of the input, and finding ones it does not use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def at(df: DataFrame, name: str) -> Column:
    """The column of just this name, dots and back ticks included."""
    return df["`" + name.replace("`", "``") + "`"]


def unused(columns: list[str], *names: str) -> list[str]:
    """Each name, with underscores before it until no column is called so in whatever letter case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out

"""Names of symbols as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_name(name: Column) -> Column:
    """A setter's getter, a local field without its trailing space."""
    return F.regexp_replace(F.trim(name), "_=$", "")


def alternative_names(name: Column, owner: Column, kind: Column) -> Column:
    """The names by which a symbol can be mentioned."""
    base = canonical_name(name)
    return F.when(kind.isin("val", "var"), F.array(F.concat(base, F.lit("_=")), base)).when(base == "apply", F.array(F.lit("apply"), owner)).otherwise(F.array(base))


def display_name(qualified: Column) -> Column:
    """The last segment outside brackets, without .type."""
    bare = F.regexp_replace(qualified, r"\.type$", "")
    head = F.regexp_extract(bare, r"^([^\[]*)", 1)
    return F.concat(F.substring_index(head, ".", -1), F.substring(bare, F.length(head) + 1, F.length(bare)))


def long_display_name(qualified: Column) -> Column:
    return F.regexp_extract(qualified, r"^(.+?)(?:\.type)?$", 1)


def entity_kind(flag) -> Column:
    """The first that holds, in this order; flag(name) gives a truth column."""
    ladder = None
    for name in ("interface", "trait", "abstract class", "class", "module", "type", "method", "val", "var"):
        ladder = F.when(flag(name), name) if ladder is None else ladder.when(flag(name), name)
    return ladder.otherwise("unknown")


def decode_name(name: Column) -> Column:
    """An encoded symbolic name in source form."""
    for encoded, sign in OPERATORS.items():
        name = F.replace(name, F.lit(encoded), F.lit(sign))
    return name


#: How symbolic characters are encoded in names.
OPERATORS = {
    "$colon": ":", "$eq": "=", "$less": "<", "$greater": ">", "$plus": "+", "$minus": "-", "$times": "*", "$div": "/",
    "$percent": "%", "$amp": "&", "$bar": "|", "$up": "^", "$bang": "!", "$qmark": "?", "$at": "@", "$hash": "#",
    "$tilde": "~", "$bslash": "\\",
}

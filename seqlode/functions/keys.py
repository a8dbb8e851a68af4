"""Names and keys derived from paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def path_stem(c: str | Column) -> Column:
    """Last path segment without its last suffix; a leading dot is no suffix, and a trailing slash is ignored."""
    name = F.element_at(F.split(F.regexp_replace(_col(c), "/+$", ""), "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def suffix_key(c: str | Column) -> Column:
    """What follows the last underscore, or everything if there is none."""
    return F.substring_index(_col(c), "_", -1)


def normalized_id(c: str | Column) -> Column:
    """Suffix key of the stem. Different names may agree in it."""
    return suffix_key(path_stem(c))


def config_tag(model: Column, layer: Column, clusters: Column) -> Column:
    return F.format_string("%s_l%d_k%d", model, layer, clusters)


def relative_gain(x: str | Column, y: str | Column) -> Column:
    """(x - y) / y, with y at least 1e-9."""
    return (_col(x) - _col(y)) / F.greatest(_col(y), F.lit(1e-9))

"""Lenient casts, angles and texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_float(text: Column) -> Column:
    """A number, or null where the text is none."""
    return text.try_cast("double")


def floats(text: Column) -> Column:
    """Numbers parted by commas or white space; null unless every part is one."""
    parts = F.transform(F.split(F.trim(text), r"[,\s]+"), lambda x: x.try_cast("double"))
    return F.when((F.trim(text) != "") & ~F.exists(parts, lambda x: x.isNull()), parts)


def first_float(text: Column) -> Column:
    return F.try_element_at(floats(text), F.lit(1))


def dms_to_deg(degrees: Column, minutes: Column, seconds: Column, reference: Column) -> Column:
    """Signed degrees; null if a part is missing. S and W are negative."""
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(F.upper(F.trim(reference)).isin("S", "W"), -value).otherwise(value)


def wrap_angle(degrees: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0


def suffix(file: Column) -> Column:
    """The capital letter after the last underscore of a file's stem, or null."""
    stem = F.regexp_replace(F.regexp_extract(file, r"([^/\\]+)$", 1), r"(?<=.)\.[^.]*$", "")
    found = F.regexp_extract(stem, "_([A-Z])$", 1)
    return F.when(found != "", found)


def is_photo(path: Column) -> Column:
    return F.lower(path).rlike(r"\.jpe?g$")


def is_tiff(path: Column) -> Column:
    return F.lower(path).rlike(r"\.tiff?$")


def is_number(text: Column) -> Column:
    """A numeric string, thousands commas allowed."""
    return F.replace(F.trim(text), F.lit(","), F.lit("")).rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")


def version_parts(text: Column) -> Column:
    """Three integers of a version text; missing ones are 0."""
    part = lambda i: F.coalesce(F.regexp_extract(text, r"^\D*(\d+)(?:\.(\d+))?(?:\.(\d+))?", i).try_cast("int"), F.lit(0))
    return F.array(part(1), part(2), part(3))


def proxy_name(file: Column) -> Column:
    return F.concat(file, F.lit(".jpg"))


def file_of_proxy(name: Column) -> Column:
    return F.regexp_replace(name, r"\.jpg$", "")


def rms(value: Column) -> Column:
    """Root mean square over rows with a finite value; null without any."""
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.sqrt(F.avg(F.when(ok, value * value)))


def drop_keys(column: Column, keys: list[str]) -> Column:
    """A map without some keys."""
    return F.map_filter(column, lambda k, _: ~k.isin(*keys))


def merged_warnings(*lists: Column) -> Column:
    """All warnings in order, each once."""
    return F.array_distinct(F.concat(*lists))


def sorted_ids(ids: Column) -> Column:
    return F.array_sort(F.array_distinct(ids))


def in_registry_order(registry: list[str], selection: Column) -> Column:
    """Names of the registry that the selection has (any case), in the registry's order."""
    lower = F.transform(selection, lambda x: F.lower(F.trim(x)))
    return F.filter(F.array(*map(F.lit, registry)), lambda x: F.array_contains(lower, F.lower(x)))


def lacks(full: Column, have: Column) -> Column:
    """Whether `have` misses an element of `full`."""
    return F.size(F.array_except(full, have)) > 0

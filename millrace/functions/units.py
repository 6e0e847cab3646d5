"""Units: normalising, groups, compatibility and conversion, as column expressions.

A null unit is the empty one. Groups and factors are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units that measure the same quantity.
GROUPS = {
    "mass": ["kg", "g", "mg", "t", "ton", "tonne", "lb", "oz"],
    "energy": ["mj", "kwh", "kj", "wh", "j", "cal", "kcal", "btu"],
    "volume": ["m3", "l", "ml", "dm3", "cm3", "gal", "ft3"],
    "area": ["m2", "km2", "cm2", "mm2", "ha", "ft2", "acre"],
    "length": ["m", "km", "cm", "mm", "ft", "in", "mile"],
    "radioactivity": ["bq", "kbq", "mbq", "gbq", "ci", "mci"],
    "time": ["s", "min", "h", "hr", "hour", "d", "day", "year", "a"],
    "count": ["item", "items", "item(s)", "unit", "units", "p", "piece", "pieces"],
}
# Factors to kg, MJ, m3 and m2.
FACTORS = {
    "kg": 1.0, "g": 0.001, "mg": 0.000001, "t": 1000.0, "ton": 1000.0, "tonne": 1000.0,
    "mj": 1.0, "kwh": 3.6, "kj": 0.001, "wh": 0.0036, "j": 0.000001,
    "m3": 1.0, "l": 0.001, "ml": 0.000001, "dm3": 0.001, "cm3": 0.000001,
    "m2": 1.0, "km2": 1000000.0, "cm2": 0.0001, "mm2": 0.000001, "ha": 10000.0,
}


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def normalize(unit: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(unit, F.lit("")))), " ", "")


def group(unit: Column) -> Column:
    """The unit's group; null where it is unknown."""
    return F.try_element_at(_map((u, g) for g, us in GROUPS.items() for u in us), normalize(unit))


def factor(unit: Column) -> Column:
    return F.try_element_at(_map(FACTORS.items()), normalize(unit))


def valid(unit: Column) -> Column:
    """Whether the unit belongs to a group."""
    return group(unit).isNotNull()


def compatible(a: Column, b: Column) -> Column:
    """Of one group; where a group is unknown, the same unit."""
    return F.when(group(a).isNull() | group(b).isNull(), normalize(a) == normalize(b)).otherwise(group(a) == group(b))


def convert(value: Column, a: Column, b: Column) -> Column:
    """``value`` in the unit ``b``; null where units are incompatible or a factor is unknown."""
    return F.when(normalize(a) == normalize(b), value).when(compatible(a, b), value * factor(a) / factor(b))


def suggestion(value: Column, a: Column, b: Column) -> Column:
    """compatible, needs_conversion and converted value of a recorded value against a matched flow's unit."""
    same = normalize(a) == normalize(b)
    return F.struct(
        compatible(a, b).alias("compatible"), (compatible(a, b) & ~same).alias("needs_conversion"), convert(value, a, b).alias("converted")
    )


def peers(unit: Column) -> Column:
    """All units of the unit's group; of an unknown one, itself."""
    lookup = F.create_map(*[c for g, us in GROUPS.items() for c in (F.lit(g), F.array(*[F.lit(u) for u in us]))])
    return F.coalesce(F.try_element_at(lookup, group(unit)), F.array(unit))


_VALUES = lambda pairs: ", ".join(f"('{a}', {b!r})" for a, b in pairs)
#: The same tables in SQL: unit_groups(u, g) and unit_factors(u, f).
SQL = f"""unit_groups(u, g) AS (VALUES {_VALUES((u, g) for g, us in GROUPS.items() for u in us)}),
unit_factors(u, f) AS (VALUES {", ".join(f"('{u}', CAST({f!r} AS DOUBLE))" for u, f in FACTORS.items())})"""

"""Search keywords by life-cycle-inventory category, for laser powder bed fusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category -> (core keywords, extended keywords).
LEXICON = {
    "Function Unit": (("manufactured", "part", "product", "kg"), ("fabricated", "printed", "produced", "batch", "component", "specimen")),
    "Product": (("product", "part", "component"), ("output", "yield", "manufactured", "fabricated", "specimen")),
    "Raw Material": (("powder", "material", "feedstock"), ("Ti6Al4V", "Ti-6Al-4V", "AlSi10Mg", "316L", "stainless steel", "aluminum alloy", "particle size", "virgin powder")),
    "Process Energy": (("electricity", "kWh", "energy consumption"), ("power consumption", "MJ", "SEC", "specific energy consumption", "machine power", "printing energy", "build energy", "laser power", "heater power", "bed power")),
    "Post-processing Energy": (("heat treatment", "machining", "post-processing"), ("annealing", "stress relief", "furnace", "solution treatment", "aging", "CNC", "milling", "grinding", "cutting", "drilling", "surface finishing", "polishing", "blasting", "HIP", "hot isostatic pressing", "wire EDM", "EDM")),
    "Feedstock Energy": (("atomization", "powder production"), ("atomization energy", "powder manufacturing", "feedstock production", "feedstock energy", "gas atomization", "water atomization", "plasma atomization")),
    "Gas": (("argon", "nitrogen", "gas"), ("inert gas", "shielding gas", "Ar", "N2", "gas consumption", "gas flow rate", "purge gas", "protective atmosphere", "compressed air")),
    "Cooling Media": (("water", "coolant"), ("cooling water", "cutting fluid", "cooling liquid", "lubricant", "machining fluid", "coolant flow")),
    "Recovered Material": (("recovered powder", "recycled powder"), ("sieved powder", "reused powder", "unmelted powder", "loose powder", "surplus powder", "excess powder")),
    "Waste": (("waste", "scrap", "support"), ("support structure", "failed print", "rejected part", "machining waste", "trimmings", "offcuts", "powder waste", "contaminated powder", "condensate", "filter")),
    "Emission": (("emission", "particulate"), ("VOC", "volatile organic compound", "particle", "fume", "smoke", "wastewater", "effluent", "off-gas", "air emission", "dust")),
}


def _lists(part: int) -> Column:
    return F.create_map(*[c for k, v in LEXICON.items() for c in (F.lit(k), F.array(*[F.lit(w) for w in v[part]]))])


def core(category: Column) -> Column:
    return F.try_element_at(_lists(0), category)


def extended(category: Column) -> Column:
    return F.try_element_at(_lists(1), category)


def suggest(category: Column, seed: Column, n: int = 2, least: int = 5, most: int = 8) -> Column:
    """The core keywords and ``n`` extended ones (more, where that is under ``least``), chosen by the seed's hash."""
    chosen = F.transform(F.array_sort(F.transform(extended(category), lambda w: F.struct(F.md5(F.concat(seed, F.lit(":"), w).cast("binary")), w.alias("w")))), lambda s: s["w"])
    take = F.greatest(F.lit(n), least - F.size(core(category)))
    return F.slice(F.concat(core(category), F.slice(chosen, F.lit(1), take)), 1, most)


#: The same table in SQL: lexicon(category, core, extended).
SQL = "lexicon(category, core, extended) AS (VALUES " + ", ".join(
    f"('{k}', [{', '.join(repr(w) for w in a)}], [{', '.join(repr(w) for w in b)}])" for k, (a, b) in LEXICON.items()
) + ")"

"""Matching recorded flows to catalog flows: exact names, keyword candidates, vector ranking, units."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from millrace.functions import units
from millrace.operators.retrieval import digest, digest_vectors, hash_embedding
from millrace.operators.substrings import holders
from millrace.operators.text_features import materials, processes
from millrace.operators.vectors import most_alike
from millrace.sources.tables import checkpointed


def keywords(text: Column, n: int = 3) -> Column:
    """Those of the first ``n`` words of a name, in lower case, that have more than two characters."""
    return F.filter(F.slice(F.regexp_extract_all(F.lower(text), F.lit(r"\S+"), F.lit(0)), 1, n), lambda w: F.length(w) > 2)


def exact(flows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Case-insensitive equality of names, literally; of equal names the least uuid."""
    names = catalog.groupBy(F.lower("name").alias("__n")).agg(F.min("uuid").alias("uuid"))
    return flows.join(names, F.lower("name") == F.col("__n"), "left").drop("__n")


def search_names(catalog: DataFrame, term: str, n: int = 20) -> DataFrame:
    return catalog.where(F.contains(F.lower("name"), F.lit(term.lower()))).orderBy("name", "uuid").limit(n)


# What catalog flows the recorded categories may match.
MATERIAL, MATERIAL_TYPES = ("Raw Material", "Gas", "Cooling Media"), ("PRODUCT_FLOW", "ELEMENTARY_FLOW")
ENERGY = ("Process Energy", "Post-processing Energy", "Feedstock Energy")
ENERGY_NAMES, ENERGY_CATEGORIES = "(?i)electricity|energy|power", ("Energy carriers and technologies",)
EMISSION, EMISSION_TYPE, EMISSION_CATEGORIES = "Emission", "ELEMENTARY_FLOW", ("Emission to air", "Emission to water", "Emission to soil")
WASTE, WASTE_TYPE, WASTE_CATEGORIES = "Waste", "WASTE_FLOW", "(?i)waste"


def rule_of(category: Column) -> Column:
    """The name of the rule that a recorded category sets; ``any`` where it sets none."""
    return (
        F.when(category.isin(*MATERIAL), "material").when(category.isin(*ENERGY), "energy").when(category == EMISSION, "emission")
        .when(category == WASTE, "waste").otherwise("any")
    )


def rules(name: Column, flow_type: Column, categories: Column) -> Column:
    """The names of the rules that a catalog flow fits; ``any`` always. Nulls fit nothing else."""
    listed = lambda known: F.arrays_overlap(categories, F.array(*[F.lit(c) for c in known]))
    fits = {
        "material": flow_type.isin(*MATERIAL_TYPES), "energy": F.coalesce(F.rlike(name, F.lit(ENERGY_NAMES)), F.lit(False)) | F.coalesce(listed(ENERGY_CATEGORIES), F.lit(False)),
        "emission": (flow_type == EMISSION_TYPE) & listed(EMISSION_CATEGORIES),
        "waste": F.coalesce(flow_type == WASTE_TYPE, F.lit(False)) | F.coalesce(F.exists(categories, lambda c: F.rlike(c, F.lit(WASTE_CATEGORIES))), F.lit(False)),
    }
    return F.array_compact(F.array(F.lit("any"), *[F.when(fit, F.lit(rule)) for rule, fit in fits.items()]))


def needles(name: Column) -> Column:
    """What a catalog name must hold one of: the whole name asked for, or one of its keywords."""
    return F.array_distinct(F.concat(F.array(F.lower(name)), keywords(name)))


def candidates(flows: DataFrame, catalog: DataFrame, least: int = 10, most: int = 100) -> DataFrame:
    """(query_id, uuid, fits, rank): the first ``most`` catalog flows whose names hold a query's name or one of its keywords.

    Those that fit the category's rule come alone where there are ``least``, else all. First are short names, then the
    alphabet's, then uuids: an order that depends on no query, so the first ``most`` for a name, for a string and a rule,
    and for a query follow from each other, and each step hands on no more than these. Strings are looked up once however
    many queries ask them, by :func:`millrace.operators.substrings.holders`. Null and blank names have no candidates;
    flows without a name are none.
    """
    flows = flows.where(F.length(F.trim("name")) > 0).select("query_id", rule_of(F.col("category")).alias("rule"), needles(F.col("name")).alias("__needles"))
    asked = flows.select("query_id", "rule", F.explode("__needles").alias("needle"))
    known = catalog.where("name IS NOT NULL").select("uuid", F.lower("name").alias("name"), rules(F.col("name"), F.col("flow_type"), F.col("categories")).alias("__fits"))
    known = known.withColumn("__rule", F.explode("__fits"))
    firsts = known.withColumn("__k", F.row_number().over(Window.partitionBy("name", "__rule").orderBy("uuid"))).where(F.col("__k") <= most)
    firsts = firsts.select(F.col("name").alias("__name"), "uuid", "__rule", "__fits")
    held = holders(asked, known.select("name")).withColumnRenamed("needle", "__needle")
    order = F.length("__name"), "__name", "uuid"
    each = held.join(firsts, F.col("name") == F.col("__name")).drop("name")
    each = each.withColumn("__k", F.row_number().over(Window.partitionBy("__needle", "__rule").orderBy(*order))).where(F.col("__k") <= most)
    hits = asked.join(each, (F.col("needle") == F.col("__needle")) & F.col("__rule").isin("any", F.col("rule")))
    hits = hits.select("query_id", "rule", "__rule", "__name", "uuid", F.array_contains("__fits", F.col("rule")).alias("fits")).distinct()
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "__rule").orderBy(*order))).where(F.col("rank") <= most)
    own = F.col("rule") == F.col("__rule")
    enough = F.coalesce(F.max(F.when(own, F.col("rank"))).over(Window.partitionBy("query_id")) >= least, F.lit(False))
    hits = hits.withColumn("__enough", enough).where(F.when(F.col("__enough"), own).otherwise(F.col("__rule") == "any"))
    return hits.select("query_id", "uuid", "fits", "rank")


def ranked(flows: DataFrame, catalog: DataFrame, dims: int = 64) -> DataFrame:
    """(query_id, uuid, similarity, unit): what each flow may match, in the catalog flows' units.

    ``flows`` (query_id, name, category, q, query) with an equal name in ``catalog`` (uuid, name, flow_type, categories,
    unit, v, text) match that alone, with similarity 1. Others have all of their :func:`candidates` with cosines. Flows
    without a vector have one made from their text, queries from ``query``, of ``dims`` entries.
    """
    found = exact(flows, catalog)
    one = found.where("uuid IS NOT NULL").select("query_id", "uuid", F.lit(1.0).alias("similarity"))
    rest = found.where("uuid IS NULL").drop("uuid")
    with_norm = lambda df, v, text: df.withColumn("__v", F.coalesce(v, hash_embedding(F.coalesce(text, F.lit("")), dims))).withColumn("__n", norm(F.col("__v")))
    asked = with_norm(rest, F.col("q"), F.col("query")).select("query_id", F.col("__v").alias("__q"), F.col("__n").alias("__qn"))
    known = with_norm(catalog, F.col("v"), F.col("text")).select("uuid", "__v", "__n")
    pairs = candidates(rest, catalog).select("query_id", "uuid").join(known, "uuid").join(asked, "query_id")
    cosine = dot(F.col("__q"), F.col("__v")) / (F.col("__qn") * F.col("__n") + 1e-8)
    return one.unionByName(pairs.select("query_id", "uuid", F.round(cosine, 9).alias("similarity"))).join(catalog.select("uuid", "unit", *_unit_columns("unit", "__c")), "uuid")


def match_flows(flows: DataFrame, catalog: DataFrame, k: int = 5, dims: int = 64) -> DataFrame:
    """(query_id, uuid, rank, similarity, unit, compatible): the stages of matching, one after the other.

    ``flows`` also have the ``unit`` that they ask for. Of what :func:`ranked` finds those in a compatible unit stay, or all
    where none is or no unit is asked; then the best ``k`` are taken. An exact match stays whatever its unit.
    """
    both = ranked(flows, catalog, dims).join(flows.select("query_id", F.col("unit").alias("__qu"), *_unit_columns("unit", "__a")), "query_id")
    kept = _kept(both, _comparable("__a", "__c"), "__qu")
    return top_k(kept, ["query_id"], "similarity", ["uuid"], k).select("query_id", "uuid", "rank", F.round("similarity", 6).alias("similarity"), "unit", "compatible")


def functional_units(scopes: DataFrame, flows: DataFrame) -> DataFrame:
    """(session_id, functional_unit): a session's scope with the names of its raw materials.

    ``scopes`` (session_id, seq, description, parameter_name), the first of which counts; ``flows`` (session_id, name,
    category, seq). Names come in the order of ``seq``, repeated ones once each time; sessions with neither have no row.
    """
    first = F.min_by(F.coalesce(F.nullif("description", F.lit("")), F.col("parameter_name")), "seq")
    scoped = scopes.groupBy(F.col("session_id").alias("__s")).agg(F.coalesce(first, F.lit("")).alias("__unit"))
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("name", F.lit("")).alias("name")))), lambda r: r["name"]), ", ")
    raw = flows.where("category = 'Raw Material'").groupBy("session_id").agg(named.alias("__materials"))
    both = raw.join(scoped, F.col("session_id") == F.col("__s"), "full").withColumn("session_id", F.coalesce("session_id", "__s"))
    unit = (
        F.when(F.col("__materials").isNull(), F.col("__unit")).when(F.coalesce("__unit", F.lit("")) == "", F.concat(F.lit("Materials: "), "__materials"))
        .otherwise(F.concat("__unit", F.lit(" (materials: "), "__materials", F.lit(")")))
    )
    return both.select("session_id", unit.alias("functional_unit"))


def context_query(name: Column, category: Column, unit: Column, note: Column, chunk: Column) -> Column:
    """What a flow is asked by: its name, materials of the functional unit, processes of the note, two materials of the chunk, its category.

    Parts are distinct but for case; those of one character are left out. Without any context it is name and category.
    """
    return _asked_by(name, materials(unit), processes(note), _of_chunk(chunk), category)


def _of_chunk(chunk: Column) -> Column:
    return F.slice(materials(F.when(F.length(chunk) > 10, chunk)), 1, 2)


def _asked_by(name: Column, unit_materials: Column, note_processes: Column, chunk_materials: Column, category: Column) -> Column:
    """:func:`context_query` of what was found in its texts."""
    none = F.array().cast("array<string>")
    parts = F.concat(F.array(name), *[F.coalesce(found, none) for found in (unit_materials, note_processes, chunk_materials)], F.array(category))
    # the parts are made once, as the one entry of an array, and looked at from there
    named = F.transform(F.array(F.filter(parts, lambda p: F.length(p) > 1)), lambda ps: F.struct(ps.alias("ps"), F.transform(ps, lambda p: F.lower(p)).alias("low")))
    unique = F.transform(named, lambda s: F.array_join(F.filter(s["ps"], lambda p, i: F.array_position(s["low"], F.lower(p)) == i + 1), " "))
    return F.get(unique, F.lit(0))


#: What flows ask by: those that agree in all of it have one query and one answer.
_ALIKE = "name", "category", "unit", "note", "chunk", "__said", "__of_unit"


def batch_match(flows: DataFrame, scopes: DataFrame, catalog: DataFrame, k: int = 3, dims: int = 64) -> DataFrame:
    """Every recorded flow with its matches, an array of struct(rank, uuid, similarity, unit, compatible), and why it has none.

    ``flows`` (session_id, seq, name, category, unit, note, chunk and more). Products are not matched. What a session's
    text names is looked for once a session, and flows with the same texts have their query made once. Queries of the same name,
    category and text are ranked once, and filtered once for each unit, as by :func:`match_flows`.
    """
    joined = _with_said(flows, scopes)
    rows = joined.withColumn("__row", _id_of(*_ALIKE))
    told = _answered(joined.select(*_ALIKE).distinct(), catalog, k, dims).select(_id_of(*_ALIKE).alias("__r"), "query", "matches", "skipped")
    return rows.join(told, F.col("__row") == F.col("__r"), "left").select(*flows.columns, "query", "matches", "skipped")  # each has one


def batch_counts(flows: DataFrame, scopes: DataFrame, catalog: DataFrame, k: int = 3, dims: int = 64) -> DataFrame:
    """(name, category, unit, query, matches, skipped, n): what :func:`batch_match` says, and of how many flows it says so.

    Flows are read and counted once by what they ask; none meets its answer by itself. Equal answers to flows that differ
    in their texts are rows of their own.
    """
    alike = _with_said(flows, scopes).groupBy(*_ALIKE).agg(F.count("*").alias("n"))
    return _answered(alike, catalog, k, dims).select("name", "category", "unit", "query", "matches", "skipped", "n")


def _id_of(*key: str) -> Column:
    return F.sha2(F.to_json(F.struct(*key)), 256)


def _with_said(flows: DataFrame, scopes: DataFrame) -> DataFrame:
    """Flows with whether their session has a functional unit, and the materials that it names."""
    said = functional_units(scopes, flows).select("session_id", F.col("functional_unit").isNotNull().alias("__said"), materials(F.col("functional_unit")).alias("__of_unit"))
    return flows.join(said, "session_id", "left")


def _answered(alike: DataFrame, catalog: DataFrame, k: int, dims: int) -> DataFrame:
    """``alike``, no two rows of which ask the same, with query, matches and skipped."""
    context = F.coalesce("__said", F.lit(False)) | F.coalesce("note", "chunk").isNotNull()
    query = F.when(context, _asked_by(F.col("name"), F.col("__of_unit"), processes(F.col("note")), _of_chunk(F.col("chunk")), F.col("category"))).otherwise(F.concat_ws(" ", "name", "category"))
    each = alike.withColumn("query", query).withColumn("query_id", _id_of("name", "category", "query"))
    each = checkpointed(each.withColumn("__ask", _id_of("query_id", "unit")))  # read by many look-ups
    product = F.coalesce(F.col("category") == "Product", F.lit(False))
    asked = each.where(~product)
    queries = asked.select("query_id", "name", "category", "query").distinct()
    found = ranked(queries.withColumn("q", F.lit(None).cast("array<double>")), catalog, dims)
    units_asked = asked.select(F.col("query_id").alias("__id"), "__ask", F.col("unit").alias("__qu")).distinct().select("*", *_unit_columns("__qu", "__a"))
    both = found.join(units_asked, F.col("query_id") == F.col("__id")).drop("query_id", "__id").withColumnRenamed("__ask", "query_id")
    got = top_k(_kept(both, _comparable("__a", "__c"), "__qu"), ["query_id"], "similarity", ["uuid"], k).withColumn("similarity", F.round("similarity", 6))
    got = got.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "uuid", "similarity", "unit", "compatible"))).alias("__m"))
    out = each.join(got.withColumnRenamed("query_id", "__id"), (F.col("__ask") == F.col("__id")) & ~product, "left")
    empty = F.array().cast(got.schema["__m"].dataType)
    return out.select(*alike.columns, "query", F.coalesce("__m", empty).alias("matches"), F.when(product, SKIPPED).alias("skipped"))


#: Fixed value: why products have no match.
SKIPPED = "Product flows are system outputs, not environmental flows"


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


@F.arrow_udf(DoubleType())
def dot(a: pa.Array, b: pa.Array) -> pa.Array:
    """Products of vectors of one length, a batch at a time."""
    n = len(a)
    left, right = (x.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for x in (a, b))
    return pa.array(np.einsum("ij,ij->i", left, right))


def similarity_of_distance(d: Column) -> Column:
    """Above 1 the reciprocal of 1 + d, else d itself between 0 and 1: not monotone, kept as it is defined."""
    return F.when(d > 1, 1 / (1 + d)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), d)))


def top_k(scored: DataFrame, by: list[str], score: str, tie: list[str], k: int) -> DataFrame:
    """The ``k`` best rows of each group, ranked from 1. Each task keeps its own best before anything shuffles."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def match_quality(best: DataFrame, least: float) -> DataFrame:
    """One row: queries, those whose best match (score) has ``least`` similarity, their share, and their mean best similarity."""
    hit = F.col("score") >= least
    return best.agg(
        F.count("*").alias("total"), F.count_if(hit).alias("matched"), F.round(F.count_if(hit) / F.greatest(F.count("*"), F.lit(1)), 6).alias("rate"),
        F.round(F.coalesce(F.avg(F.when(hit, F.col("score"))), F.lit(0.0)), 6).alias("mean_similarity"),
    )


#: Candidates and queries of :func:`match_processes` that meet in one task.
SHARE, BLOCK = 1 << 16, 1 << 14


def match_processes(asked: DataFrame, processes: DataFrame, k: int = 5, most: int | None = 500, dims: int = 64) -> DataFrame:
    """(query_id, uuid, rank, similarity): the ``k`` best processes for a name and a location.

    ``asked`` (query_id, name, location), ``processes`` (uuid, name, categories). With ``most`` None all processes are
    candidates, else the first ``most`` by uuid alone. Texts are name and location, name and categories.

    Processes with equal texts are alike to every query, so the ``k`` least uuids of a text stand for it. What is left meets
    the queries in a grid, as 16 bytes each, so that neither side is ever whole in one task; a task asks a text once and
    leaves ``k`` rows for each query. The pairs compared grow with the product of the different texts of both sides.
    """
    text = F.concat_ws(" ", F.coalesce("name", F.lit("")), "categories")
    known = (processes if most is None else processes.orderBy("uuid").limit(most)).select("uuid", digest(text).alias("__d"))
    known = known.withColumn("__k", F.row_number().over(Window.partitionBy("__d").orderBy("uuid"))).where(F.col("__k") <= k).drop("__k")
    rows = asked.select("query_id", digest(F.concat_ws(" ", "name", F.nullif("location", F.lit("")))).alias("__d"))
    shares, blocks = max(1, -(-known.count() // SHARE)), max(1, -(-rows.count() // BLOCK))
    upto = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    dealt = lambda df: df.repartition(2 * shares * blocks, "__block", "__share").groupBy("__block", "__share")
    left = dealt(known.withColumn("__share", F.pmod(F.xxhash64("__d"), F.lit(shares))).withColumn("__block", upto(blocks)))
    right = dealt(rows.withColumn("__block", F.pmod(F.xxhash64("query_id", "__d"), F.lit(blocks))).withColumn("__share", upto(shares)))

    def best(part: pa.Table, some: pa.Table) -> pa.Table:
        part = part.take(pc.sort_indices(part, sort_keys=[("uuid", "ascending")], null_placement="at_start"))
        once = some.column("__d").combine_chunks().dictionary_encode()
        found, cosines = most_alike(digest_vectors(once.dictionary, dims), digest_vectors(part.column("__d"), dims), k)
        of = once.indices.to_numpy()
        ids = some.column("query_id").take(pa.array(np.repeat(np.arange(len(of)), found.shape[1])))
        return pa.table([ids, part.column("uuid").take(pa.array(found[of].ravel())), pa.array(cosines[of].ravel())], ["query_id", "uuid", "similarity"])

    pairs = left.cogroup(right).applyInArrow(best, f"query_id {asked.schema['query_id'].dataType.simpleString()}, uuid string, similarity double")
    return top_k(pairs, ["query_id"], "similarity", ["uuid"], k).select("query_id", "uuid", "rank", F.round("similarity", 6).alias("similarity"))


def keep_compatible(matches: DataFrame, query_unit: str, unit: str) -> DataFrame:
    """Unit-compatible matches of each query; all of them where none is compatible or the query has no unit."""
    return _kept(matches, units.compatible(F.col(query_unit), F.col(unit)), query_unit)


def _unit_columns(unit: str, name: str) -> list[Column]:
    """A unit's group and normal form, made before rows meet."""
    return [units.group(F.col(unit)).alias(f"{name}g"), units.normalize(F.col(unit)).alias(f"{name}n")]


def _comparable(a: str, b: str) -> Column:
    """What :func:`millrace.functions.units.compatible` says, by the columns of :func:`_unit_columns`."""
    return F.coalesce(F.col(f"{a}g") == F.col(f"{b}g"), F.col(f"{a}n") == F.col(f"{b}n"))


def _kept(matches: DataFrame, compatible: Column, query_unit: str) -> DataFrame:
    rows = matches.withColumn("compatible", compatible)
    some = F.max("compatible").over(Window.partitionBy("query_id"))
    asked = F.length(F.trim(F.coalesce(query_unit, F.lit("")))) > 0
    return rows.withColumn("__some", some).where(F.col("compatible") | ~F.col("__some") | ~asked).drop("__some")


def first_mapping(mapping: DataFrame, keys: list[str]) -> DataFrame:
    """The first mapping of each action."""
    return mapping.groupBy(*keys).agg(F.min_by("uuid", "place").alias("mapped"))


def exchanges(rows: DataFrame, mapping: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded flows with a mapped or stored match, in the matched flow's unit where it can be converted."""
    rows = rows.join(first_mapping(mapping, keys), keys, "left").withColumn("uuid", F.coalesce("mapped", "stored")).where("uuid IS NOT NULL")
    found = rows.join(catalog.select("uuid", F.col("unit").alias("flow_unit"), F.col("name").alias("flow_name")), "uuid", "left")
    new = units.convert(F.col("value"), F.col("unit"), F.col("flow_unit"))
    return found.withColumn("__new", new).withColumn("amount", F.coalesce("__new", "value")).withColumn("amount_unit", F.when(F.col("__new").isNotNull(), F.col("flow_unit")).otherwise(F.col("unit")))


def coverage(rows: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Mapped rows of all, by session, and whether any is."""
    rows = rows.join(first_mapping(mapping, keys), keys, "left")
    n = F.count_if(F.coalesce("mapped", "stored").isNotNull())
    return rows.groupBy("session_id").agg(n.alias("mapped"), F.count("*").alias("total"), (n > 0).alias("ready"))


def impacts(exchanged: DataFrame, factors: DataFrame) -> DataFrame:
    """Impact totals by category: amounts times factors."""
    return exchanged.join(factors, "uuid").groupBy("impact").agg(F.round(F.sum(F.col("amount") * F.col("factor")), 5).alias("total"), F.count("*").alias("n"))

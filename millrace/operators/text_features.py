"""Text and table features of chunks."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The units that count in texts, basis words, materials and processes.
UNITS = "kilowatt hour|millimeter|kilojoule|megajoule|kilogram|kilowatt|Celsius|Kelvin|tonne|joule|meter|gram|watt|kWh|MWh|cm³|mm³|cm3|mm3|Wh|kJ|MJ|GJ|kW|MW|mL|ml|kg|mg|m³|m3|cm|mm|μm|°C|g|t|L|l|J|W|m|℃"
NUMBER = r"(?:[0-9]{1,3}(?:[ ,][0-9]{3})*(?:\.[0-9]+)?|[0-9]+\.[0-9]+|[0-9]+(?:[eE][+-]?[0-9]+)?)"
VALUE_UNIT = rf"(?i)(?<![0-9])({NUMBER})(?![0-9])\s*({UNITS})(?![\p{{L}}\p{{N}}_])"
BASIS = r"(?i)(?:\bper\s+(?:part|batch|build|unit|hour|day|tonne|kg)|/t\b|/kg\b|/h\b|each\b)"
MATERIALS = (
    r"(?i)\b(316L|304|X2CrNiMo[0-9]+|Ti-?6Al-?4V|Inconel|AlSi10Mg|17-?4 ?PH)\b", r"(?i)\b(stainless\s+steel|steel|aluminum|aluminium|titanium|copper|nickel|chromium)\b",
    r"(?i)\b(PLA|ABS|PETG|nylon|polyethylene|polypropylene|plastic)\b", r"(?i)\b(electricity|power|energy|natural\s+gas)\b",
)
PROCESSES = (
    r"(?i)\b(SLM|SLS|FDM|EBM|DMLS|3D\s+printing|additive\s+manufacturing)\b", r"(?i)\b(atomization|milling|machining|heat\s+treatment)\b", r"(?i)\b(laser|sintering|melting|printing)\b",
)
# Indicators and the words that name them.
INDICATORS = {
    "GWP": "global warming potential|gwp|全球变暖潜值|温室气体",
    "CED": "cumulative energy demand|ced|累积能源需求|能源消耗",
    "AP": "acidification potential|ap|酸化潜值",
    "EP": "eutrophication potential|ep|富营养化潜值",
    "POCP": "photochemical ozone creation potential|pocp|光化学臭氧",
    "能耗": "energy consumption|能源消耗|电力消耗|燃料消耗",
    "碳足迹": "carbon footprint|碳足迹|碳排放|co2.*排放",
    "生命周期": "life cycle|lifecycle|生命周期|全生命周期",
}


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def found(text: Column, patterns, n: int) -> Column:
    """The first ``n`` distinct matches, pattern by pattern."""
    return F.slice(F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])), 1, n)


def materials(text: Column) -> Column:
    return found(F.lower(text), MATERIALS, 5)


def processes(text: Column) -> Column:
    return found(text, PROCESSES, 3)


def once(value: Column, made) -> Column:
    """``made`` of a value that is made once for each row: as the one entry of an array, however often it is looked at."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _distinct_but_for_case(texts: Column) -> Column:
    """The first of texts that differ in case alone, in order."""
    first = lambda ts, low: F.filter(ts, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    return once(texts, lambda ts: once(F.transform(ts, lambda x: F.lower(x)), lambda low: first(ts, low)))


def has_basis(text: Column) -> Column:
    return F.rlike(text, F.lit(BASIS))


def indicators(text: Column) -> Column:
    # plain words are looked for as they are, an expression only where its first word stands
    said = lambda low, w: F.contains(low, F.lit(w)) if ".*" not in w else F.contains(low, F.lit(w.split(".*")[0])) & F.rlike(low, F.lit(w))
    names = lambda low: [F.when(reduce(or_, (said(low, w) for w in p.split("|"))), F.lit(k)) for k, p in INDICATORS.items()]
    return once(F.lower(text), lambda low: F.array_compact(F.array(*names(low))))


def _warnings(count: Column, score: Column) -> Column:
    """What is odd about the features: none is good."""
    return F.array_compact(F.array(
        F.when(score > 1, "QPS > 1.0, should be clamped to 1.0"), F.when((count == 0) & (score < 0.02), "Low quantitative evidence, consider Pivot"),
    ))


def _density(count: Column, clean: Column) -> Column:
    return F.bround(F.least(count / F.greatest(F.size(F.split(clean, " ")), F.lit(1)), F.lit(1.0)), 3)


def decision_features(text: Column) -> Column:
    """struct of pattern_count, score (per word, three digits), examples, basis and warnings of a narrative text."""
    short = lambda hits: F.transform(hits, lambda h: once(F.trim(h), lambda t: F.when(F.length(t) > 20, F.concat(F.substring(t, 1, 17), F.lit("..."))).otherwise(t)))

    def features(clean: Column, hits: Column) -> Column:
        score = _density(F.size(hits), clean)
        return F.struct(
            F.size(hits).alias("pattern_count"), score.alias("score"), F.slice(_distinct_but_for_case(short(hits)), 1, 3).alias("examples"), has_basis(clean).alias("basis"),
            _warnings(F.size(hits), score).alias("warnings"), F.lit(False).alias("is_table"),
        )

    found = lambda clean: F.struct(clean.alias("clean"), F.regexp_extract_all(clean, F.lit(VALUE_UNIT), F.lit(0)).alias("hits"))
    return once(once(collapse(text), found), lambda x: features(x["clean"], x["hits"]))


#: Chunk kinds whose numbers and units stand apart, the last two of former versions.
TABLE_KINDS = ("table_section", "table_keyvalue", "table_full", "table_row")
# Fixed values of the table rules.
_TITLED, _CITED, _NUMBERED = re.compile(r"##?\s*[Tt]able|##?\s*[Ff]igure"), re.compile(r"page|p\.|ref|cite", re.I), re.compile(r"\b\d+\.\d+(\.\d+)?\b")
_COMPOUND = tuple(re.compile(p, re.I) for p in (r"\b[A-Za-z]+/[A-Za-z]+\b", r"\b[A-Za-z]+[²³]\b", r"\b[A-Za-z]+\s*/\s*[A-Za-z]+\b"))
_PARTS = {"L", "l", "g", "kg", "m", "cm", "mm", "min", "h", "hr", "kWh", "MJ", "kJ", "W", "kW"}
_SINGLE = {"l", "g", "t", "m"}
_NUM, _UNIT = re.compile(rf"(?<!\d){NUMBER}(?!\d)"), re.compile(f"(?:{UNITS})", re.I)


def _around(text: str, a: int, b: int, before: int, after: int) -> str:
    return text[max(0, a - before) : b + after]


def table_numbers(text: str) -> list[re.Match]:
    """Numbers that name no table, figure, section, page or reference, by the 15 characters on either side."""

    def counts(m: re.Match) -> bool:
        near = _around(text, m.start(), m.end(), 15, 15)
        return not (_TITLED.search(near) or _CITED.search(near) or ("|" not in near and _NUMBERED.search(m.group())))

    return [m for m in _NUM.finditer(text) if counts(m)]


def compound_units(text: str) -> list[str]:
    """Distinct units over units, squares and cubes that hold a known unit, pattern by pattern."""
    found = (m.group() for p in _COMPOUND for m in p.finditer(text))
    return list(dict.fromkeys(u for u in found if _PARTS & set(re.split(r"[/²³\s]+", u))))


def table_units(text: str, numbers: list[re.Match]) -> list[str]:
    """Plain units: longer ones that occur at most three times, single letters near a number, in a unit column or a compound."""
    found = list(_UNIT.finditer(text))
    often = Counter(m.group().lower() for m in found)

    def counts(m: re.Match) -> bool:
        unit, n = m.group().lower(), often[m.group().lower()]
        if len(unit) > 1:
            return n <= 3
        compound = bool(set("/²³") & set(_around(text, m.start(), m.end(), 2, 5)))
        if unit not in _SINGLE or (n > 2 and not compound):
            return False
        column = _around(text, m.start(), m.end(), 30, 30).lower()
        return compound or ("unit" in column and "|" in column) or any(abs(m.start() - x.end()) <= 5 or abs(m.end() - x.start()) <= 5 for x in numbers)

    return [m.group() for m in found if counts(m)]


def table_patterns(text: str) -> tuple[int, list[str]]:
    """The lesser of numbers and units (compound ones where there are any), and three examples: numbers, then the units."""
    numbers, compound = table_numbers(text), compound_units(text)
    units = compound or table_units(text, numbers)
    n, shown = min(len(numbers), len(units)), units[: 2 if compound else 3]
    examples = [m.group() for m in numbers[: min(3, n) if n or compound else 3]]
    if shown and (n or compound):
        examples.append(f"({', '.join(dict.fromkeys(shown))})")
    return n, examples[:3]


def _of_distinct(texts: pd.Series, made) -> list:
    """``made`` of each text of a batch, equal ones once; null as empty."""
    known = {t: made(t) for t in set(texts.fillna(""))}
    return [known[t] for t in texts.fillna("")]


def _table_patterns(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_of_distinct(texts, table_patterns), columns=["n", "examples"])


def table_features(text: Column) -> Column:
    """The same struct as :func:`decision_features` for a table, in which numbers and units are counted apart."""
    clean = collapse(F.coalesce(text, F.lit("")))
    found = F.pandas_udf(_table_patterns, "n int, examples array<string>")(clean)

    def features(clean: Column, n: Column, examples: Column) -> Column:
        score = _density(n, clean)
        return F.struct(n.alias("pattern_count"), score.alias("score"), examples.alias("examples"), has_basis(clean).alias("basis"), _warnings(n, score).alias("warnings"), F.lit(True).alias("is_table"))

    return once(F.struct(clean.alias("clean"), found.alias("found")), lambda x: features(x["clean"], x["found"]["n"], x["found"]["examples"]))


def chunk_features(chunks: DataFrame, text: str = "text", kind: str = "chunk_type") -> DataFrame:
    """Adds ``features``: of chunks of the table kinds as tables, of all others, and those without a kind, as texts."""
    tables = F.coalesce(F.col(kind).isin(*TABLE_KINDS), F.lit(False))
    narrative = chunks.where(~tables).withColumn("features", decision_features(F.coalesce(F.col(text), F.lit(""))))
    return narrative.unionByName(chunks.where(tables).withColumn("features", table_features(F.col(text))))


# Values with units, by pattern; the third gives percentages.
FACTS = (
    r"(\d+\.?\d*)\s*(kWh/kg|MJ/kg|kg/m²|g/片|kg|ton|kWh|MJ|℃|°C|MPa|bar)", r"(\d+\.?\d*)\s*(kwh|mj|kg|g|ton|celsius|pascal|watt|w)", r"(\d+\.?\d*)\s*(%)",
    r"(\d+\.?\d*)\s*(小时|hour|h|分钟|min|秒|s)",
)
_FACT = "array<struct<value:double,unit:string,formatted:string,context:string,start:int,end:int>>"


def numeric_facts(text: Column) -> Column:
    """Values with units, pattern by pattern, with up to 20 characters on either side and their place."""
    return F.pandas_udf(_numeric_facts, _FACT)(text)


def facts(text: str) -> list[dict]:
    found = [m for p in FACTS for m in re.finditer(p, text, re.I)]
    return [
        dict(value=float(m[1]), unit=m[2], formatted=f"{m[1]} {m[2]}", context=_around(text, m.start(), m.end(), 20, 20).strip(), start=m.start(), end=m.end())
        for m in found
    ]


def _numeric_facts(texts: pd.Series) -> pd.Series:
    return pd.Series(_of_distinct(texts, facts), dtype=object)


def lines(text: Column) -> Column:
    return F.split(F.trim(text), "\n")


def table_score(text: Column) -> Column:
    """The heuristic score of a text as a table: 3 and more, with 3 lines and more, is one."""
    ls, n = lines(text), F.size(lines(text))
    some = lambda p: F.size(F.filter(ls, p))
    pipe = some(lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)
    numeric = some(lambda x: F.size(F.regexp_extract_all(x, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1))) >= 2)
    pairs = some(lambda x: F.rlike(x, F.lit(r"[A-Za-z0-9_]+ *[:|] *[0-9]+")))
    rule = some(lambda x: F.rlike(F.trim(x), F.lit(r"^[ \-|=]+$")))
    score = (
        F.when(F.rlike(text, F.lit(r"(?i)(?:Table|表格|表) *[0-9]+")), 3).otherwise(0) + F.when(pipe >= n * 0.3, 2).otherwise(0)
        + F.when(numeric >= n * 0.4, 2).otherwise(0) + F.when(pairs >= 3, 1).otherwise(0) + F.when(rule >= 1, 1).otherwise(0)
    )
    return F.when(n < 3, 0).otherwise(score)


def looks_like_table(content: Column) -> Column:
    """A title among the first three lines, or two lines with three pipes."""
    ls = F.split(content, "\n")
    titled = F.exists(F.slice(ls, 1, 3), lambda x: F.rlike(x, F.lit("(?i)table [0-9]+")))
    piped = F.size(F.filter(ls, lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 3)) >= 2
    return titled | piped


#: Endings of sentences, which titles do not have, and what is no title.
SENTENCE_ENDS = "[.。,，;；]$"
NO_TITLES = (r"^\d{4}$", r"^(abstract|摘要)$", r"^(page|第.*?页)", r"^(author|作者|by)\s*:")


def title(content: Column) -> Column:
    """The first line that is not blank as a title: 20 to 250 characters, no sentence's end, no excluded form; else null."""
    first = F.try_element_at(F.filter(F.transform(F.split(content, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != ""), F.lit(1))
    bad = F.rlike(first, F.lit(SENTENCE_ENDS)) | F.rlike(first, F.lit("(?i)" + "|".join(NO_TITLES)))
    return F.when(F.length(first).between(20, 250) & ~bad, first)


#: Heads of tables that are made from lines of text.
_MADE_HEAD = "| Parameter | Value | Unit | Description |\n|-----------|-------|------|-------------|\n"
_TABLE_TITLE = r"(?i)(?:Table|表格|表)\s*\d+"


def text_to_markdown(text: Column) -> Column:
    """A text that is a table as Markdown: its title, then its lines as they are if any has a pipe, else one row a line.

    ``name: value`` gives two cells, anything else one; lines that name a table are the title, or go.
    """
    ls = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    named = F.filter(ls, lambda x: F.rlike(x, F.lit(_TABLE_TITLE)))
    head = F.concat(F.lit("## "), F.coalesce(F.try_element_at(named, F.lit(1)), F.lit("Table (Detected)")), F.lit("\n\n"))
    pair = r"^(.+?)\s*[:|]\s*(.+)$"
    row = lambda x: F.when(F.rlike(x, F.lit(pair)), F.concat(F.lit("| "), F.trim(F.regexp_extract(x, pair, 1)), F.lit(" | "), F.trim(F.regexp_extract(x, pair, 2)), F.lit(" | | |\n"))).otherwise(F.concat(F.lit("| "), x, F.lit(" | | | |\n")))
    made = F.concat(F.lit(_MADE_HEAD), F.array_join(F.transform(F.filter(ls, lambda x: ~F.rlike(x, F.lit(_TABLE_TITLE))), row), ""))
    return F.concat(head, F.when(F.exists(ls, lambda x: F.contains(x, F.lit("|"))), F.array_join(ls, "\n")).otherwise(made))


def pipes_to_html(text: Column) -> Column:
    """The pipe table in a text as HTML: lines with three pipes and more, the first of them the head, rules left out.

    A text with fewer than two such lines stays as it is.
    """
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^\|", ""), r"\|$", "")
    kept = F.transform(F.filter(F.split(F.trim(text), "\n"), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 3), bare)
    rows = F.filter(kept, lambda x: ~F.rlike(x, F.lit(r"^[-: |]*$")))
    cells_ = lambda x, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.split(x, r"\|"), lambda c: F.concat(F.lit(f"<{tag}>"), F.trim(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    body = F.array_join(F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda x: cells_(x, "td")), "")
    head = F.coalesce(F.transform(F.slice(rows, 1, 1), lambda x: cells_(x, "th"))[0], F.lit(""))
    html = F.concat(F.lit("<table><thead>"), head, F.lit("</thead><tbody>"), body, F.lit("</tbody></table>"))
    return F.when(F.size(kept) >= 2, html).otherwise(text)


def clean_table(rows: Column) -> Column:
    """Rows of a raw table (array of arrays): nulls empty, cells trimmed, empty rows gone; no rows where fewer than two are left."""
    trimmed = F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))))
    kept = F.filter(trimmed, lambda r: F.exists(r, lambda c: c != ""))
    return F.when(F.size(kept) >= 2, kept).otherwise(F.slice(kept, 1, 0))


def enhanced_query(name: Column, category: Column, text: Column) -> Column:
    """Name, category and the text's materials and processes, distinct but for case."""
    return F.array_join(_distinct_but_for_case(F.concat(F.array(name, category), materials(text), processes(text))), " ")


def cells(tables: DataFrame) -> DataFrame:
    """(table_id, row, col, header, value) of pipe tables in ``text``; short rows are cut to their headers."""
    rows = tables.where("table_id IS NOT NULL").select("table_id", F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit("|")) & ~F.rlike(x, F.lit(r"^[ \-|]+$"))).alias("lines"))
    parts = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    body = F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1)))).alias("at", "line")
    body = rows.select("table_id", parts(F.get("lines", F.lit(0))).alias("headers"), body).select("table_id", (F.col("at") + 1).alias("row"), "headers", parts(F.col("line")).alias("cells"))
    return body.select("table_id", "row", "headers", F.posexplode(F.slice("cells", 1, F.size("headers"))).alias("col", "value")).withColumn("header", F.get("headers", F.col("col"))).drop("headers")


def keyvalues(cells_: DataFrame) -> DataFrame:
    """One text for each row of a table: its cells that are not empty as ``header: value``, a line each."""
    pair = F.struct("col", F.concat("header", F.lit(": "), "value").alias("kv"))
    lines_ = F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda s: s["kv"]), "\n")
    return cells_.where("value <> ''").groupBy("table_id", "row").agg(lines_.alias("content"))


# What cells are about, and how a summary names it.
CELL_KINDS = {
    "energy_consumption": ("电[力耗]|energy|electricity|kwh|mj|功率|power|瓦特|watt", "耗电|用电|电量|能源|能耗|消耗"),
    "material_flows": ("材料|material|substance|kg|ton|gram|质量|重量", "原料|物料|成分|组分|投入|input"),
    "emissions": ("排放|emission|co2|ghg|carbon|废气|污染", "温室气体|碳排放|二氧化碳|甲烷|氧化亚氮"),
    "process_parameters": ("工艺|process|temperature|pressure|时间|温度|压力", "参数|条件|设定|操作|运行"),
}
KIND_NAMES = {"energy_consumption": "能源消耗", "material_flows": "材料流", "emissions": "排放", "process_parameters": "工艺参数"}


def _of_kind(kind: str) -> Column:
    """Whether a cell or its header names the kind."""
    return F.rlike(F.lower(F.concat_ws("\n", "value", "header")), F.lit("|".join(CELL_KINDS[kind])))


def classified(cells_: DataFrame) -> DataFrame:
    """Cells that are not empty, once for each kind that they or their headers name, with the last value and unit in them."""
    hit = [F.when(_of_kind(k), F.lit(k)) for k in CELL_KINDS]
    found = lambda i: F.try_element_at(F.regexp_extract_all(F.lower("value"), F.lit(r"([0-9]+\.?[0-9]*)\s*([a-zA-Z/]+)"), F.lit(i)), F.lit(-1))
    rows = cells_.where("value <> ''").withColumn("kind", F.explode(F.array_compact(F.array(*hit))))
    rows = rows.withColumn("number", found(1).try_cast("double")).withColumn("unit", found(2))
    return rows.withColumn("formatted", F.concat(found(1), F.lit(" "), "unit"))


def table_summary(cells_: DataFrame) -> DataFrame:
    """table_id and summary: how many rows and columns a table has, and how many cells of each kind."""
    counts = [F.count_if((F.col("value") != "") & _of_kind(k)).alias(k) for k in CELL_KINDS]
    # a table is one text, so its rows' numbers are fewer than its characters
    rows = cells_.groupBy("table_id").agg(F.size(F.collect_set("row")).alias("rows"), F.size(F.collect_set("col")).alias("cols"), *counts)
    named = [F.when(F.col(k) > 0, F.concat(F.lit(f"{KIND_NAMES[k]}: "), F.col(k).cast("string"), F.lit("项"))) for k in CELL_KINDS]
    listed = F.array_join(F.array_compact(F.array(*named)), ", ")
    told = F.concat(F.lit("表格包含"), F.col("rows").cast("string"), F.lit("行"), F.col("cols").cast("string"), F.lit("列数据"))
    return rows.select("table_id", F.concat(told, F.when(listed != "", F.concat(F.lit(" | LCA数据: "), listed)).otherwise("")).alias("summary"))


def markdown_sections(rows: DataFrame, size: int = 600) -> DataFrame:
    """Tables (table_id, headers, row, cells) as Markdown sections of about ``size`` characters, each with the headers.

    A table whose header and rows (as long as its first) fit is one section; else (size - header - 100) // first row's
    length rows go into each, one at least.
    """
    line = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[\r\n]", " ")), " | "), F.lit(" |\n"))
    rows = rows.withColumn("line", line)
    head = F.concat(F.lit("| "), F.array_join("headers", " | "), F.lit(" |\n|"), F.repeat(F.lit("---|"), F.size("headers")), F.lit("\n"))
    sizes = rows.groupBy("table_id").agg(F.min_by(F.length("line"), "row").alias("len"), F.count("*").alias("n"), F.first("headers").alias("headers"))
    sizes = sizes.withColumn("head", head).withColumn(
        "per", F.when(F.length("head") + F.col("n") * F.col("len") <= size, F.col("n")).otherwise(F.greatest(F.lit(1), F.floor((size - F.length("head") - 100) / F.col("len"))))
    )
    sizes = sizes.select(F.col("table_id").alias("__t"), "head", "per", "n")
    rows = rows.join(sizes, F.col("table_id") == F.col("__t")).withColumn("section", (F.floor((F.col("row") - 1) / F.col("per")) + 1).cast("int"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]), "")
    out = rows.groupBy("table_id", "section", "head", "per", "n").agg(body.alias("body"), F.count("*").alias("rows"))
    return out.select("table_id", "section", F.ceil(F.col("n") / F.col("per")).cast("int").alias("sections"), "rows", F.concat("head", "body").alias("content"))

"""Fill-in-the-middle samples by escaped marker injection.

A delimiter is escaped in the text, one regexp_replace appends it after every unit, and its count is the number of units.
``substring_index`` then takes the parts between ranked delimiters, so no text is turned into an array of its units. The
parts lose their delimiters, are unescaped and put together in one of two orders. Functions of Spark alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The delimiter, and the escape that takes its place in texts that hold either.
END, ESCAPE = "\u0001", "\u0002"
#: Patterns of units over escaped text; every character belongs to one. A code point that is escaped stays one unit.
UNITS = {"chars": f"(?s){ESCAPE}[ed]|.", "words": r"\S+\s*|\s+", "lines": r"[^\n]*\n|[^\n]+"}
MARKERS = ("<P>", "<S>", "<M>")


def escaped(text: Column) -> Column:
    """The text without any delimiter in it."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(END), F.lit(ESCAPE + "d"))


def unescaped(text: Column) -> Column:
    """What :func:`escaped` was given, delimiters that were appended being dropped."""
    plain = F.replace(F.replace(text, F.lit(END), F.lit("")), F.lit(ESCAPE + "d"), F.lit(END))
    return F.replace(plain, F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def _index(text: Column, mark: str, n: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(mark), n.cast("int"))


def _check(markers: tuple[str, str, str]) -> None:
    """Markers must be told apart wherever they stand: none may end as another, or itself, begins, nor hold another."""
    for i, a in enumerate(markers):
        for j, b in enumerate(markers):
            if not a or (i != j and a in b) or any(a.endswith(b[:n]) for n in range(1, len(b))):
                raise ValueError(f"markers {markers} can't be told apart")


def split_points(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers, the first groups of the hex sha256 of ``seed:key``. A null key is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, units: str = "chars", plain_percent: int = 10,
    spm_percent: int = 20, markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """id, n, form, prefix, middle, suffix, output and restored for every row of ``docs``.

    ``n`` counts the units (``chars``: code points, ``words``, ``lines``) of a text. Two cuts, which follow from the id and
    ``seed`` alone, part it; ``form`` is ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or ``plain``, where
    the text is empty, holds a marker, or falls into ``plain_percent``. ``output`` holds the parts behind their markers,
    plain the text; ``restored`` is the text rebuilt from ``output`` and ``form``. The parts are null in plain rows.

    Null texts are empty. Rows with equal ids are cut by the same numbers, repeated rows alike; a null id is one as any
    other. Texts may hold the delimiter and the escape. Other columns are not read; no rows give no rows.
    """
    _check(markers)
    if not 0 <= plain_percent <= 100 or not 0 <= spm_percent <= 100:
        raise ValueError("shares are percentages")
    first, last, mid = markers
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    h = split_points(F.col("__id"), seed)
    rows = rows.select("__id", "__text", escaped(F.col("__text")).alias("__escaped"), *(x.alias(f"__h{i}") for i, x in enumerate(h)))
    rows = rows.withColumn("__marked", F.regexp_replace("__escaped", F.lit(UNITS[units]), F.lit("$0" + END)))
    rows = rows.withColumn("n", (F.length("__marked") - F.length("__escaped")).cast("long"))
    held = F.lit(False)
    for m in markers:
        held = held | F.contains(F.col("__text"), F.lit(m))
    plain = (F.col("__text") == "") | held | (F.col("__h2") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("__h3") % 100 < spm_percent, "spm").otherwise("psm")
    cuts = [F.col(f"__h{i}") % (F.col("n") + 1) for i in (0, 1)]
    rows = rows.withColumn("form", form).withColumn("__a", F.least(*cuts)).withColumn("__b", F.greatest(*cuts))
    cut = lambda c: F.when(F.col("form") != "plain", unescaped(c))
    rows = rows.withColumn("__head", F.when(F.col("form") != "plain", _index(F.col("__marked"), END, F.col("__b"))))
    rows = rows.select(
        "__id", "__text", "n", "form", cut(_index(F.col("__head"), END, F.col("__a"))).alias("prefix"),
        cut(_index(F.col("__head"), END, F.col("__a") - F.col("__b"))).alias("middle"),
        cut(_index(F.col("__marked"), END, F.col("__b") - F.col("n") - 1)).alias("suffix"),
    )
    parts = F.when(F.col("form") == "psm", F.concat(F.lit(first), "prefix", F.lit(last), "suffix", F.lit(mid), "middle"))
    parts = parts.when(F.col("form") == "spm", F.concat(F.lit(last), "suffix", F.lit(first), "prefix", F.lit(mid), "middle"))
    rows = rows.withColumn("output", parts.otherwise(F.col("__text")))
    return rows.select(
        F.col("__id").alias(id_col), "n", "form", "prefix", "middle", "suffix", "output", restored(F.col("output"), F.col("form"), markers).alias("restored")
    )


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that a sample was made of."""
    first, last, mid = markers
    middle = _index(output, mid, F.lit(-1))
    head = _index(output, mid, F.lit(1))
    behind = lambda c, m: _index(c, m, F.lit(-1))
    psm = F.concat(behind(_index(head, last, F.lit(1)), first), middle, behind(head, last))
    spm = F.concat(behind(head, first), middle, behind(_index(head, first, F.lit(1)), last))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(samples: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What :func:`transform` gives as lengths and digests."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return samples.select(
        id_col, "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"),
    )

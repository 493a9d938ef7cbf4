"""Line protocol: ``measurement[,tag=value…] field=value[,field=value…] [nanoseconds]``, parsed by JVM expressions only.

A backslash escapes comma, space, equals sign, quote and backslash; before any other character it stands for itself. The
patterns take an escape as one unit and never go back, so the work grows with a line's length.
Values: 42i and 42u whole numbers, t/f/true/false 1 and 0, quoted text, all else doubles. A
missing or zero time is the time of ingest. Lines that don't parse have a reason in ``error`` and are never fatal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PAIR = r"\\(?:.|$)"
_NAME, _KEY, _FIELD_KEY = rf"(?:[^, \\]++|{_PAIR})++", rf"(?:[^,= \\]++|{_PAIR})++", rf'(?:[^,= "\\]++|{_PAIR})++'
_VALUE = rf'(?:"(?:[^"\\]++|{_PAIR})*+"|{_FIELD_KEY})'
_TAG, _FIELD = rf"({_KEY})=({_KEY})", rf"({_FIELD_KEY})=({_VALUE})"
#: The head (measurement and tags), the fields and the time of a line.
_LINE = rf"(?s)^({_NAME}(?:,{_KEY}={_KEY})*+) ++({_FIELD_KEY}={_VALUE}(?:,{_FIELD_KEY}={_VALUE})*+)(?: ++(-?\d++))?\s*+$"


def _plain(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\\")), F.regexp_replace(c, r'\\([\\, ="])', "$1")).otherwise(c)


def _pairs(text: Column, pattern: str, value) -> Column:
    """Entries (key, value) of all matches of a pattern with two groups."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("k"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("v"))
    return F.transform(both, lambda e: F.struct(_plain(e["k"]).alias("key"), value(e["v"]).alias("value")))


def _typed(v: Column) -> Column:
    """(long, double, text) of a field value; one of them is set."""
    quoted, low = v.startswith('"'), F.lower(v)
    text = F.when(quoted, _plain(F.substring(v, F.lit(2), F.length(v) - 2)))
    marked = ~quoted & F.right(v, F.lit(1)).isin("i", "u") & v.rlike(r"^-?\d+[iu]$")
    whole = F.when(marked, F.substring(v, F.lit(1), F.length(v) - 1).try_cast("long")).when(low.isin("t", "true"), F.lit(1).cast("long")).when(low.isin("f", "false"), F.lit(0).cast("long"))
    return F.struct(whole.alias("i"), F.when(~quoted & whole.isNull(), v.try_cast("double")).alias("d"), text.alias("s"))


def _once(df: DataFrame) -> DataFrame:
    """Columns computed once a row, however often they are used: projections don't merge through a generator."""
    return df.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("__row")).select("__row.*")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: what follows costs more than the exchange of few large files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """measurement, tags (map), fields (map to struct<i,d,s>), ts, ts_ns, line, error. Blank lines and # comments go."""
    rows = lines.select(F.trim(F.col(column)).alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    rows = spread(rows).select("line", *[F.regexp_extract("line", _LINE, i).alias(f"__{i}") for i in range(1, 4)])
    rows = rows.withColumn("__m", F.regexp_extract("__1", f"^{_NAME}", 0)).withColumn("__1", F.substring("__1", F.length("__m") + 2, F.length("__1")))
    # The fields of a line that fits are never empty.
    rows = rows.select("line", _plain(F.col("__m")).alias("measurement"), _pairs(F.col("__1"), _TAG, _plain).alias("__t"), _pairs(F.col("__2"), _FIELD, _typed).alias("__f"), F.col("__3").try_cast("long").alias("__ns"))
    keys = lambda c: F.transform(c, lambda e: e["key"])
    rows = rows.select("*", F.size(F.array_distinct(keys("__t"))).alias("__nt"), F.size(F.array_distinct(keys("__f"))).alias("__nf"))
    bad = F.exists("__f", lambda e: e["value"]["i"].isNull() & e["value"]["d"].isNull() & e["value"]["s"].isNull())
    twice = (F.col("__nt") < F.size("__t")) | (F.col("__nf") < F.size("__f"))
    rows = rows.withColumn("error", F.when(F.size("__f") == 0, "not a line").when(bad, "not a value").when(twice, "a key twice"))
    fine = F.col("error").isNull()
    now = F.unix_micros(F.current_timestamp()) * 1000
    ns = F.when(F.coalesce("__ns", F.lit(0)) == 0, now).otherwise(F.col("__ns"))
    # Null entries instead of broken ones: maps refuse keys that come twice.
    out = rows.select(
        F.when(fine, F.col("measurement")).alias("measurement"), F.map_from_entries(F.when(fine, F.col("__t"))).alias("tags"), F.map_from_entries(F.when(fine, F.col("__f"))).alias("fields"),
        F.when(fine, F.timestamp_micros(F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000))).cast("timestamp_ntz")).alias("ts"), F.when(fine, ns).alias("ts_ns"), "line", "error")
    return _once(out)


def measurement(parsed: DataFrame, name: str, tags: list[str], fields: dict[str, str]) -> DataFrame:
    """One measurement as a table: ts, tags as text, fields as INT64, FLOAT64 or SYMBOL; keys not asked for are dropped."""
    rows = parsed.where(F.col("error").isNull() & (F.col("measurement") == name))
    pick = {"INT64": lambda f: F.coalesce(f["i"], f["d"].try_cast("long")), "FLOAT64": lambda f: F.coalesce(f["d"], f["i"].cast("double")), "SYMBOL": lambda f: f["s"]}
    return rows.select("ts", *[F.try_element_at("tags", F.lit(t)).alias(t) for t in tags], *[pick[k](F.try_element_at("fields", F.lit(f))).alias(f) for f, k in fields.items()])


def shapes(parsed: DataFrame) -> dict[str, tuple[list[str], dict[str, str]]]:
    """Tags and field types of every measurement (schema-sized). A field seen as both whole and double is double."""
    good = parsed.where(F.col("error").isNull())
    kinds = F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("key"), F.when(e["value"]["s"].isNotNull(), "SYMBOL").when(e["value"]["i"].isNotNull(), "INT64").otherwise("FLOAT64").alias("kind")))
    rows = good.select("measurement", F.explode(kinds).alias("f")).groupBy("measurement", "f.key").agg(F.collect_set("f.kind").alias("kinds")).collect()
    out: dict[str, tuple[list[str], dict[str, str]]] = {}
    for m, key, found in sorted((r[0], r[1], r[2]) for r in rows):
        out.setdefault(m, ([], {}))[1][key] = "SYMBOL" if "SYMBOL" in found else "FLOAT64" if "FLOAT64" in found else "INT64"
    for m, tag in good.select("measurement", F.explode(F.map_keys("tags"))).distinct().sort("measurement", "col").collect():
        out[m][0].append(tag)
    return out

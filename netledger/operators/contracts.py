"""Data contracts that report all problems at once, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def problems(df: DataFrame, tests: dict[str, Column], key: str, sample: int = 5) -> DataFrame:
    """(code, n, sample): for each test, how many rows break it and the least keys among them.

    One pass: counts are combined map-side, and the sample is a bounded list per task and code.
    """
    codes = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in tests.items()]))
    broken = df.select(F.col(key).alias("key"), F.explode(codes).alias("code"))
    counts = broken.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    least = broken.select("code", "key").withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("key"))).filter(F.col("r") <= sample)
    lists = least.groupBy("code").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("sample"))
    return counts.join(lists, "code")


def identifier_problems(df: DataFrame, key: str) -> DataFrame:
    """(problem, identifier, n): blank identifiers, and all that occur more than once."""
    c = F.nullif(F.trim(F.col(key).cast("string")), F.lit(""))
    counted = df.groupBy(c.alias("identifier")).agg(F.count(F.lit(1)).alias("n"))
    problem = F.when(F.col("identifier").isNull(), "blank").when(F.col("n") > 1, "duplicate")
    return counted.withColumn("problem", problem).filter("problem IS NOT NULL").select("problem", "identifier", "n")


#: Codes of accuracy, and the box that coordinates must lie in.
ACCURACIES = ("block", "town", "city", "unmatched")
BOX = (20.0, 122.0, 46.0, 154.0)


def coordinate_tests(lat: Column, lon: Column, crs: Column, accuracy: Column, expected: int, box: tuple = BOX) -> dict[str, Column]:
    """Tests of the coordinate contract, for ``problems``."""
    from netledger.functions.text import epsg

    wild = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    odd = F.coalesce(wild(lat), F.lit(False)) | F.coalesce(wild(lon), F.lit(False))
    return {
        "crs_missing": epsg(crs).isNull(), "crs_wrong": epsg(crs) != expected, "half_missing": lat.isNull() != lon.isNull(), "not_finite": odd,
        "outside": ~odd & ((lat < box[0]) | (lat > box[2]) | (lon < box[1]) | (lon > box[3])),
        "accuracy_unknown": ~F.coalesce(accuracy.isin(*ACCURACIES), F.lit(False)),
        "accuracy_contradicts": (accuracy == "unmatched") != (lat.isNull() & lon.isNull()),
    }


def split_by_boundary(df: DataFrame, name: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose name doesn't end as the pattern says, and those whose name does (to be reported)."""
    bad = F.coalesce(F.col(name).rlike(pattern), F.lit(False))
    return df.filter(~bad), df.filter(bad)


def mark_summary(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, yes, no, unknown) of nullable boolean columns."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields])).alias("e")).select("e.*")
    return long.groupBy("field").agg(F.count_if(F.col("v")).alias("yes"), F.count_if(~F.col("v")).alias("no"), F.count_if(F.col("v").isNull()).alias("unknown"))


def row_digest(*columns: str) -> Column:
    """SHA-256 of the canonical JSON of the columns in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def in_or_all(c: Column, wanted: list[str] | str) -> Column:
    """Membership, where ``all`` admits everything; null is in no list."""
    return F.lit(True) if wanted == "all" else F.coalesce(c.isin(*wanted), F.lit(False))


def overall(statuses: DataFrame, status: str = "status") -> DataFrame:
    """One row: fail before not_evaluable before pass; no rows are not_evaluable."""
    s = F.col(status)
    return statuses.agg(F.when(F.count_if(s == "fail") > 0, "fail").when((F.count_if(s != "pass") > 0) | (F.count(F.lit(1)) == 0), "not_evaluable").otherwise("pass").alias("status"))


#: Rows whose digests are combined into one before the pieces are.
PIECE = 10_000


def rows_digest(df: DataFrame, order: list[str]) -> DataFrame:
    """One row (rows, digest): SHA-256 over all row digests in order, which binds a table to a seal.

    Digests are first combined per PIECE rows of the order, and then those of the pieces, so the last
    task holds one hash per piece. The result depends on the rows and their order alone.
    """
    from netledger.operators.running import ranked

    rows = ranked(df.select(*order, row_digest(*df.columns).alias("_d")), [], [*order, "_d"])
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", c))), lambda s: s[c]), ","), 256)
    pieces = rows.withColumns({"_piece": F.floor((F.col("rank") - 1) / PIECE), "_at": F.col("rank")}).groupBy("_piece").agg(F.count(F.lit(1)).alias("c"), joined("_d").alias("_h"))
    return pieces.withColumn("_at", F.col("_piece")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), joined("_h").alias("digest"))


def usable_at(date: Column, crs: Column, wanted: int, valid_from: Column, valid_to: Column) -> Column:
    """Whether a coordinate may be used on a day: its system fits, and the day lies in its validity; open ends admit all."""
    from netledger.functions.text import epsg

    after = F.coalesce(date >= valid_from, valid_from.isNull())
    before = F.coalesce(date <= valid_to, valid_to.isNull())
    return F.coalesce((epsg(crs) == wanted) & after & before, F.lit(False))


#: Text fields that a descriptor of a dataset must have, and families of datasets.
DESCRIPTOR_FIELDS = ("dataset_id", "family", "title", "publisher", "format", "mime", "coverage_date", "granularity", "geometry", "license", "terms")
DESCRIPTOR_FAMILIES = ("population_mesh", "admin_boundary", "depop_designation", "road", "rail", "bus", "p30")


def descriptor_tests(families: tuple[str, ...] | list[str] = DESCRIPTOR_FAMILIES) -> dict[str, Column]:
    """Tests of dataset descriptors, for ``problems``: required fields, dates, families, the coordinate
    system, the fields of the data with their types (field_schema: array<struct<name, type>>), units of
    populations, and a review of whatever may be released."""
    from netledger.functions.text import iso_date

    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    tests = {f"{f}_missing": blank(F.col(f)) for f in DESCRIPTOR_FIELDS}
    tests["family_unknown"] = ~F.coalesce(F.col("family").isin(*families), F.lit(False))
    tests["coverage_date_bad"] = ~blank(F.col("coverage_date")) & iso_date(F.col("coverage_date")).isNull()
    tests["crs_bad"] = ~F.coalesce(F.col("crs_epsg") > 0, F.lit(False))
    tests["field_schema_bad"] = F.col("field_schema").isNull() | F.exists("field_schema", lambda f: blank(f["name"]) | blank(f["type"]))
    tests["units_missing"] = (F.col("family") == "population_mesh") & blank(F.col("units"))
    tests["release_flag_missing"] = F.col("public_release_allowed").isNull()
    tests["release_without_review"] = F.coalesce(F.col("public_release_allowed"), F.lit(False)) & blank(F.col("release_review_id"))
    return tests


def access_guard(distance: Column, people: Column, part: Column) -> Column:
    """Why a population-weighted measure can't be computed over the rows, as an aggregate; null if it can.

    A missing distance or a negative or missing count makes it not evaluable, as the denominator would be partial.
    """
    wrong = F.count_if(people.isNull() | (people < 0) | part.isNull() | (part < 0) | (part > people))
    return (
        F.when(F.coalesce(F.sum(people), F.lit(0)) == 0, "zero_population").when(wrong > 0, "bad_population").when(F.count_if(distance.isNull() | F.isnan(distance) | (distance < 0)) > 0, "not_evaluable")
    )


def config_problems(radii: list[float], months: list[str], extent: list[float], allowed: tuple[float, ...]) -> list[str]:
    """Problems of an analysis configuration; an empty list if it is sound."""
    import re

    found = []
    if list(radii) != list(allowed):
        found.append("radii_not_fixed")
    if not months or list(months) != sorted(set(months)) or not all(re.fullmatch(r"[0-9]{4}-(0[1-9]|1[0-2])", m) for m in months):
        found.append("months_not_sorted_unique")
    if len(extent) != 4 or not (extent[0] < extent[2] and extent[1] < extent[3]):
        found.append("extent_not_ordered")
    return found

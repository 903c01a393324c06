"""Addresses to coordinates: a cascade of equi-joins over towns and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netledger.functions import text as tx
from netledger.session import stored


def point_means(points: DataFrame, keys: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Mean place of the points of each key; sums are combined map-side, so a big scan shuffles one row per key and task."""
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(lat).alias("lat"), F.avg(lon).alias("lon"))


def wanted_means(points: DataFrame, wanted: DataFrame, keys: list[str], deleted: Column) -> DataFrame:
    """Means of the wanted keys only: the big table is met by a semi-join and without deleted rows."""
    return point_means(points.filter(~F.coalesce(deleted, F.lit(False))).join(wanted.select(*keys).distinct(), keys, "left_semi"), keys)


def name_candidates(town: Column, shortest: int = 3) -> Column:
    """Keys under which a town may stand, with priorities: the name itself, its prefixes from long to
    short, its suffixes, and inner parts of ``shortest`` characters or more."""
    n = F.length(town)
    lengths = F.sequence(F.greatest(n - 1, F.lit(1)), F.lit(1), F.lit(-1))
    exact = F.array(F.struct(F.lit(0).alias("level"), F.lit(0).alias("order"), town.alias("key")))
    prefixes = F.transform(lengths, lambda k: F.struct(F.lit(1).alias("level"), (n - k).alias("order"), F.substring(town, F.lit(1), k).alias("key")))
    suffixes = F.transform(lengths, lambda k: F.struct(F.lit(2).alias("level"), (n - k).alias("order"), F.substring(town, n - k + 1, k).alias("key")))
    inner = F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda s: F.struct(F.lit(3).alias("level"), (n - k).alias("order"), F.substring(town, s, k).alias("key")))))
    # single characters match too much: they come last, and only at the start of the name
    one = lambda c: F.length(c["key"]) == 1
    usable = F.filter(F.concat(exact, prefixes, suffixes, inner), lambda c: F.when(c["level"] == 0, True).when(c["level"] == 3, F.length(c["key"]) >= shortest).when(one(c), False).otherwise(True))
    last = F.array(F.struct(F.lit(4).alias("level"), F.lit(0).alias("order"), F.substring(town, 1, 1).alias("key")))
    return F.when(n > 0, F.concat(usable, last))


def match_towns(addresses: DataFrame, towns: DataFrame, region: str) -> DataFrame:
    """(aid, key, level) of the best candidate of each address (aid, region, town) that is a town of the
    region; candidates are exploded and met by equality, and the least priority wins."""
    probes = addresses.select("aid", region, F.explode(name_candidates(F.col("town"))).alias("c"))
    known = towns.select(region, F.col("key").alias("_k")).distinct()
    met = probes.join(known, (probes[region] == known[region]) & (F.col("c.key") == F.col("_k")))
    best = met.groupBy("aid").agg(F.min(F.struct("c.level", "c.order", "c.key")).alias("b"))
    return best.select("aid", "b.key", "b.level")


def assemble(addresses: DataFrame, key: str, levels: list[tuple[str, DataFrame]]) -> DataFrame:
    """``addresses`` with lat, lon and accuracy of the first level (key, lat, lon) that has the address;
    ``unmatched`` without."""
    out, lat, lon, accuracy = addresses, F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit("unmatched")
    for name, found in levels:
        out = out.join(found.select(key, F.col("lat").alias(f"_{name}_lat"), F.col("lon").alias(f"_{name}_lon")), key, "left")
    for name, _ in reversed(levels):
        have = F.col(f"_{name}_lat").isNotNull()
        lat, lon = F.when(have, F.col(f"_{name}_lat")).otherwise(lat), F.when(have, F.col(f"_{name}_lon")).otherwise(lon)
        accuracy = F.when(have, F.lit(name)).otherwise(accuracy)
    return out.select(*addresses.columns, lat.alias("lat"), lon.alias("lon"), accuracy.alias("accuracy"))


def city_probes(rest: Column, shortest: Column, longest: Column) -> Column:
    """Prefixes of an address behind its region, as (order, start, key): those of the whole text, then those
    behind a county or island among its first eight characters, the longest strip first. Prefixes have the
    lengths of the cities that there are."""
    cuts = F.filter(F.sequence(F.lit(1), F.least(F.length(rest), F.lit(8))), lambda i: F.substring(rest, i, F.lit(1)).isin("郡", "島"))
    starts = F.concat(F.array(F.lit(0)), F.reverse(cuts))
    lengths = F.sequence(shortest, F.greatest(shortest, longest))
    made = F.transform(starts, lambda s: F.transform(lengths, lambda n: F.struct(F.when(s == 0, 0).otherwise(9 - s).alias("order"), s.alias("start"), F.substring(rest, s + 1, n).alias("key"), n.alias("n"))))
    return F.filter(F.flatten(made), lambda c: F.length(c["key"]) == c["n"])


def resolve_cities(addresses: DataFrame, cities: DataFrame) -> DataFrame:
    """(aid, region, city, rest, error) of addresses (aid, address): their region, the longest city (region, city) of it
    that stands at the first start that has any, and what follows. ``error`` is no_pref or no_city where there is none.

    Cities are compared by their key; of cities with one key the least name counts. Addresses must be normalized.
    """
    region = F.regexp_extract("address", tx.PREFECTURE, 1)
    cut = addresses.select("aid", "address", F.nullif(region, F.lit("")).alias("region")).withColumn("rest", F.substring(F.col("address"), F.length("region") + 1, F.length("address")))
    known = cities.filter("city IS NOT NULL AND city <> ''").groupBy("region", tx.town_key(F.col("city")).alias("city_key")).agg(F.min("city").alias("city"))
    ends = known.agg(F.coalesce(F.min(F.length("city_key")), F.lit(1)).alias("shortest"), F.coalesce(F.max(F.length("city_key")), F.lit(0)).alias("longest"))
    probes = cut.filter("region IS NOT NULL").crossJoin(F.broadcast(ends)).filter("longest > 0")  # one row
    probes = probes.select("aid", "region", F.explode(city_probes(tx.town_key(F.col("rest")), F.col("shortest"), F.col("longest"))).alias("c")).select("aid", "region", "c.*")
    met = probes.join(known, (probes["region"] == known["region"]) & (F.col("key") == F.col("city_key")))
    best = met.groupBy("aid").agg(F.min(F.struct("order", (-F.col("n")).alias("short"), "start", "n", "city")).alias("b"))
    out = cut.join(best, "aid", "left")
    behind = F.when(F.col("b").isNotNull(), F.substring(F.col("rest"), F.col("b.start") + F.col("b.n") + 1, F.length("rest"))).otherwise(F.coalesce("rest", "address"))
    return out.select("aid", "region", F.col("b.city").alias("city"), behind.alias("rest"), F.when(F.col("region").isNull(), "no_pref").when(F.col("b").isNull(), "no_city").alias("error"))


def _town_key(level: int, order: Column, start: Column, key: Column, method: str | Column, block: Column) -> Column:
    text = F.lit(method) if isinstance(method, str) else method
    return F.struct(F.lit(level).alias("level"), order.cast("int").alias("order"), start.cast("int").alias("start"), key.alias("key"), text.alias("method"), block.alias("block"))


def exact_towns(head: Column, numbers: Column) -> Column:
    """Keys of a town as it is written, with the block that its numbers name: with the first number as a quarter
    in Chinese numerals, then without numbers. Three numbers or more name no block."""
    first, none = F.get(numbers, F.lit(0)), F.lit(None).cast("string")
    quarter = tx.kanji_number(first.try_cast("int"))
    second = F.get(numbers, F.lit(1))
    made = [F.when(quarter.isNotNull(), _town_key(0, F.lit(i), F.lit(0), F.concat(head, F.lit(before), quarter, F.lit(after)), "exact_chome", second)) for i, (before, after) in enumerate((("", "丁目"), ("", "丁"), ("第", "地割")))]
    return F.array_compact(F.array(*made, _town_key(0, F.lit(3), F.lit(0), head, "exact", F.when(F.size(numbers) <= 2, first).otherwise(none))))


def inferred_towns(head: Column) -> Column:
    """Keys of towns that a written name starts with, or ends with, of two characters or more, the longest first."""
    n, none = F.length(head), F.lit(None).cast("string")
    lengths = F.filter(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda k: k <= n)
    return F.concat(
        F.transform(lengths, lambda k: _town_key(1, -k, F.lit(0), F.substring(head, F.lit(1), k), "prefix", none)),
        F.transform(F.filter(lengths, lambda k: k < n), lambda k: _town_key(2, -k, F.lit(0), F.substring(head, n - k + 1, k), "suffix", none)),
    )


def inner_towns(rest: Column, head: Column, longest: Column) -> Column:
    """Keys of towns anywhere in an address, of three characters to ``longest``, then of its first character."""
    n, none = F.length(rest), F.lit(None).cast("string")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda s: s <= n - 2)
    inner = F.transform(starts, lambda s: F.transform(
        F.filter(F.sequence(F.lit(3), F.greatest(F.least(longest, n), F.lit(3))), lambda k: s + k - 1 <= n), lambda k: _town_key(3, -k, s, F.substring(rest, s, k), "substr", none)))
    return F.concat(F.flatten(inner), F.filter(F.array(_town_key(4, F.lit(-1), F.lit(0), F.substring(head, 1, 1), "prefix1", none)), lambda c: c["key"] != ""))


def _met_towns(probes: DataFrame, known: DataFrame) -> DataFrame:
    """Best town of each address: by the level, for written names by their order and then the source, else
    by the source and then the length."""
    met = probes.alias("p").join(known.alias("k"), (F.col("p.region") == F.col("k.region")) & (F.col("p.city") == F.col("k.city")) & (F.col("p.key") == F.col("k.key")))
    written = F.col("p.level") == 0
    rank = F.struct("p.level", F.when(written, F.col("p.order")).otherwise(F.col("k.source")).alias("a"), F.when(written, F.col("k.source")).otherwise(F.col("p.order")).alias("b"), "p.start", "p.method", "p.block", "k.source", "k.town", "k.lat", "k.lon")
    return met.groupBy("aid").agg(F.min(rank).alias("t")).select("aid", "t.method", "t.block", "t.source", "t.town", "t.lat", "t.lon")


def geocode(addresses: DataFrame, towns: DataFrame, sections: DataFrame, blocks: DataFrame, cities: DataFrame) -> DataFrame:
    """(aid, region, city, town, method, source, accuracy, lat, lon, error) of every address (aid, address).

    The city is found first (``resolve_cities``), then the town in it: as it is written, by its start, by its end,
    anywhere in the address, by its first character. Each form looks among ``towns`` and then ``sections`` (region,
    city, town, lat, lon). Forms are exploded and met by equality; inner ones, which are many, only where all
    others failed. Where a town of ``towns`` was found as written and a number names a block, the mean of the block's
    rows in ``blocks`` (region, city, town, block, lat, lon, deleted) is the place; that large table meets the
    wanted blocks by a semi-join. Else it is the town's, or the city's in ``cities`` (region, city, lat, lon).
    ``accuracy`` is block, town, city or unmatched. Of towns with one key the least name counts; null and empty addresses are unmatched.
    """
    placed = resolve_cities(addresses, cities)
    tables = [d.filter("town IS NOT NULL AND town <> ''").select("region", "city", "town", "lat", "lon", F.lit(i).alias("source")) for i, d in enumerate((towns, sections))]
    known = tables[0].unionByName(tables[1]).groupBy("region", "city", "source", tx.town_key(F.col("town")).alias("key")).agg(F.min(F.struct("town", "lat", "lon")).alias("t")).select("region", "city", "source", "key", "t.*")
    parts = tx.head_and_numbers(tx.town_key(F.col("rest")))
    asked = placed.filter("city IS NOT NULL").select("aid", "region", "city", "rest", parts.alias("parts")).select(
        "aid", "region", "city", tx.town_key(tx.kanji_blocks(F.col("rest"))).alias("whole"), tx.town_key(tx.kanji_blocks(F.col("parts.head"))).alias("head"), F.col("parts.numbers").alias("numbers"))
    early = asked.select("aid", "region", "city", F.explode(F.concat(exact_towns(F.col("head"), F.col("numbers")), inferred_towns(F.col("head")))).alias("c")).select("aid", "region", "city", "c.*")
    found = stored(_met_towns(early, known))
    longest = known.agg(F.coalesce(F.max(F.length("key")), F.lit(0)).alias("longest"))
    late = asked.join(found.select("aid"), "aid", "left_anti").crossJoin(F.broadcast(longest))  # one row
    late = late.select("aid", "region", "city", F.explode(inner_towns(F.col("whole"), F.col("head"), F.col("longest"))).alias("c")).select("aid", "region", "city", "c.*")
    town = found.unionByName(_met_towns(late, known))
    out = placed.join(town.withColumnsRenamed({"lat": "town_lat", "lon": "town_lon"}), "aid", "left")
    exact = (F.col("source") == 0) & F.col("block").isNotNull()
    out = stored(out.withColumn("block", F.when(exact, F.col("block"))))
    keys = ["region", "city", "town", "block"]
    means = wanted_means(blocks.filter("lat IS NOT NULL AND lon IS NOT NULL"), out.filter("block IS NOT NULL"), keys, F.col("deleted"))
    out = out.join(means.select(*keys, F.col("lat").alias("block_lat"), F.col("lon").alias("block_lon")), keys, "left")
    centre = point_means(cities.filter("lat IS NOT NULL AND lon IS NOT NULL"), ["region", "city"]).select("region", "city", F.col("lat").alias("city_lat"), F.col("lon").alias("city_lon"))
    out = out.join(centre, ["region", "city"], "left")
    accuracy = F.when(F.col("block_lat").isNotNull(), "block").when(F.col("town_lat").isNotNull(), "town").when(F.col("city_lat").isNotNull(), "city").otherwise("unmatched")
    return out.select(
        "aid", "region", "city", "town", "method", F.when(F.col("source") == 0, "towns").when(F.col("source") == 1, "sections").alias("source"), accuracy.alias("accuracy"),
        F.coalesce("block_lat", "town_lat", "city_lat").alias("lat"), F.coalesce("block_lon", "town_lon", "city_lon").alias("lon"), "error",
    )


def quality_flags(tests: dict[str, Column]) -> Column:
    """Array of the names of the tests that hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()]))


def series_of(predicates: dict[str, Column]) -> Column:
    """Array of the series that a row belongs to, for fanning rows out."""
    return quality_flags(predicates)


def policies(offices: DataFrame, policies: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Each office once per coordinate policy: (.., policy, lat, lon)."""
    entry = F.array(*[F.struct(F.lit(n).alias("policy"), a.alias("lat"), b.alias("lon")) for n, (a, b) in policies.items()])
    return offices.select(*offices.columns, F.explode(entry).alias("_p")).select(*offices.columns, "_p.*")


def positional_differences(left: DataFrame, right: DataFrame, by: list[str], order: list[str], fields: list[str], tolerance: float) -> DataFrame:
    """(by.., ord, fields that differ) of the i-th row of one side and of the other; rows without a
    partner differ in all. Numbers may differ by the tolerance."""
    from netledger.operators.running import ranked

    a = ranked(left.select(*by, *dict.fromkeys([*order, *fields])), by, order).select(*by, F.col("rank").alias("ord"), F.struct(*fields).alias("a"))
    b = ranked(right.select(*by, *dict.fromkeys([*order, *fields])), by, order).select(*by, F.col("rank").alias("ord"), F.struct(*fields).alias("b"))
    met = a.join(b, [*by, "ord"], "full_outer")
    far = quality_flags({f: F.col(f"a.{f}").isNull() | F.col(f"b.{f}").isNull() | (F.abs(F.col(f"a.{f}") - F.col(f"b.{f}")) > tolerance) for f in fields})
    return met.select(*by, "ord", F.array_join(far, ",").alias("fields")).filter("fields <> ''")

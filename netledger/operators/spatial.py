"""Spatial joins and statistics without all-pairs products.

Points are dealt into grid cells; a join meets only the cells that its radius reaches. Cells of the
other side are joined by equality, so both sides stay distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from netledger.functions.geo import MEAN_RADIUS, geodesic, haversine
from netledger.operators.running import ranked, spare
from netledger.session import checkpointed, stored

#: Metres of a degree of latitude on the mean sphere.
DEGREE = MEAN_RADIUS * 3.141592653589793 / 180
#: Differences of Moran's I below this are rounding.
ROUNDING = 1e-9


def _near_cells(x: Column, y: Column, size: float, reach: int) -> Column:
    steps = [F.struct((F.floor(x / size) + i).alias("cx"), (F.floor(y / size) + j).alias("cy")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    return F.array(*steps)


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, size: float | None = None) -> DataFrame:
    """Rows of left (lid, x, y) with those of right (rid, x, y) at a planar distance of ``radius`` or less."""
    size = size or radius
    reach = -int(-radius // size)
    probe = left.select("lid", F.col("x").alias("lx"), F.col("y").alias("ly"), F.explode(_near_cells(F.col("x"), F.col("y"), size, reach)).alias("c"))
    held = right.select("rid", F.col("x").alias("rx"), F.col("y").alias("ry"), F.struct(F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).alias("c"))
    squared = F.pow(F.col("lx") - F.col("rx"), 2) + F.pow(F.col("ly") - F.col("ry"), 2)
    return probe.join(held, "c").filter(squared <= radius * radius).select("lid", "rid", F.sqrt(squared).alias("distance"))


def radius_counts(left: DataFrame, right: DataFrame, radii: tuple[float, ...]) -> DataFrame:
    """(lid, radius, n, nearest) for every left row and radius; n is 0 and nearest null where there is none.

    Right points are weighted per place before the join, so many at one spot are one row.
    """
    spots = right.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")).withColumn("rid", F.struct("x", "y"))
    pairs = radius_pairs(left, spots, max(radii)).join(spots.select("rid", "w"), "rid")
    sums = pairs.groupBy("lid").agg(*[F.struct(F.sum(F.when(F.col("distance") <= r, F.col("w"))).alias("n"), F.min(F.when(F.col("distance") <= r, F.col("distance"))).alias("nearest")).alias(f"_{i}") for i, r in enumerate(radii)])
    joined = left.select("lid").join(sums, "lid", "left")
    entry = F.array(*[F.struct(F.lit(float(r)).alias("radius"), F.coalesce(F.col(f"_{i}.n"), F.lit(0)).alias("n"), F.col(f"_{i}.nearest").alias("nearest")) for i, r in enumerate(radii)])
    return joined.select("lid", F.explode(entry).alias("e")).select("lid", "e.*")


def _finite(*columns: str) -> Column:
    """Whether all columns hold numbers: not null, not NaN, not infinite."""
    tests = [F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) for c in columns]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _width(spots: DataFrame, x: str, y: str, least: float, most: float) -> float:
    """The width of a cell that holds about one of the spots where there are any, within bounds."""
    box = spots.agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    if not box.n:
        return most
    wide, high = box.x1 - box.x0, box.y1 - box.y0
    fine = max(wide, high) / 64
    if not fine:
        return least
    area = fine * fine * spots.select(F.floor((F.col(x) - box.x0) / fine).alias("i"), F.floor((F.col(y) - box.y0) / fine).alias("j")).distinct().count()
    return min(most, max(least, min(area, max(wide * high, 0)) ** 0.5 / box.n ** 0.5, max(wide, high) / box.n))


def _dealt(x: str, y: str, size: float) -> Column:
    return F.struct(F.floor(F.col(x) / size).alias("cx"), F.floor(F.col(y) / size).alias("cy"))


def _circles(points: DataFrame, lat: str, lon: str, size: float, weight: Column, side: str) -> DataFrame:
    """Cells of points, each with its parent of double size, its middle, the farthest of its points from there, and their weight."""
    north = F.least(F.greatest((F.col("c.cx") + 0.5) * size, F.lit(-90.0)), F.lit(90.0))
    east = (F.col("c.cy") + 0.5) * size
    dealt = points.withColumn("c", _dealt(lat, lon, size)).withColumns({"at": north, "on": east})
    sums = dealt.groupBy("c", "at", "on").agg(F.max(haversine(F.col("at"), F.col("on"), F.col(lat), F.col(lon))).alias("r"), F.sum(weight).alias("m"))
    parent = F.struct(F.floor(F.col("c.cx") / 2).alias("cx"), F.floor(F.col("c.cy") / 2).alias("cy"))
    return sums.select(parent.alias(f"{side}p"), *[F.col(n).alias(f"{side}{n}") for n in ("c", "at", "on", "r", "m")])


def nearest_few(left: DataFrame, right: DataFrame, k: int, cell: float | None = None) -> DataFrame:
    """(lid, near: array<struct<d, rid>>): the k nearest right points (rid, lat, lon) of each left one by great
    circle, nearest first, fewer where there are fewer.

    Different places are compared, not points: many at one place are one, with the k least rids there. Pairs of a left and a
    right cell are halved from a sixteenth of all down to cells that hold about one right place where there are any, and are of
    ``cell`` degrees at most. Of a left cell's pairs those stay whose circles may come nearer to each other than others that surely
    hold k points. Ties go to the least rid. Left points without coordinates have a null array; such right points don't count.
    """
    there = right.filter(_finite("lat", "lon")).select("rid", F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    if k == 1:
        spots = there.groupBy("rlat", "rlon").agg(F.array(F.min("rid")).alias("rids"))
    else:
        few = there.withColumn("place", F.row_number().over(Window.partitionBy("rlat", "rlon").orderBy("rid"))).filter(F.col("place") <= k)
        spots = few.groupBy("rlat", "rlon").agg(F.sort_array(F.collect_list("rid")).alias("rids"))
    spots = checkpointed(spots)
    asked = left.filter(_finite("lat", "lon")).select("lid", "lat", "lon")
    places = checkpointed(asked.select("lat", "lon").distinct())
    kind = f"array<struct<d:double,rid:{right.schema['rid'].dataType.simpleString()}>>"
    size = leaf = _width(spots, "rlat", "rlon", 0.005, min(8.0, cell or 8.0))
    box = places.union(spots.select("rlat", "rlon")).agg((F.max("lat") - F.min("lat")).alias("high"), (F.max("lon") - F.min("lon")).alias("wide")).first()
    while size < max(box.high or 0, box.wide or 0) / 16:  # some hundred cells on either side
        size *= 2
    pairs = None
    while size >= leaf:
        a, b = _circles(places, "lat", "lon", size, F.lit(1), "l"), _circles(spots, "rlat", "rlon", size, F.size("rids"), "r")
        met = a.crossJoin(b) if pairs is None else pairs.join(a, "lp").join(b, "rp")
        apart, radii = haversine(F.col("lat"), F.col("lon"), F.col("rat"), F.col("ron")), F.col("lr") + F.col("rr")
        met = met.withColumn("apart", apart).withColumn("most", F.col("apart") + radii)
        cells = Window.partitionBy("lc")
        if k == 1:
            sure = F.min("most").over(cells)
        else:
            met = met.withColumn("upto", F.sum("rm").over(cells.orderBy("most").rangeBetween(Window.unboundedPreceding, 0)))
            sure = F.min(F.when(F.col("upto") >= k, F.col("most"))).over(cells)
        # a metre for rounding
        kept = met.withColumn("sure", sure).filter(F.col("sure").isNull() | (F.col("apart") - radii <= F.col("sure") + 1))
        pairs = checkpointed(kept.select(F.col("lc").alias("lp"), F.col("rc").alias("rp")))
        size /= 2
    size *= 2
    asks, holds = places.withColumn("lp", _dealt("lat", "lon", size)), spots.withColumn("rp", _dealt("rlat", "rlon", size))
    found = asks.join(pairs, "lp").join(holds, "rp").withColumn("d", haversine(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon")))
    if k == 1:
        best = found.groupBy("lat", "lon").agg(F.array(F.min(F.struct("d", F.get("rids", F.lit(0)).alias("rid")))).alias("near"))
    else:  # the k nearest points stand at the first k places by distance and least rid
        place = Window.partitionBy("lat", "lon").orderBy("d", F.get("rids", F.lit(0)))
        top = found.select("lat", "lon", "d", "rids").withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)
        each = top.select("lat", "lon", "d", F.explode("rids").alias("rid"))
        best = each.groupBy("lat", "lon").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "rid"))), 1, k).alias("near"))
    out = asked.join(best, ["lat", "lon"], "left").select("lid", F.col("near").cast(kind).alias("near"))
    return out.unionByName(left.filter(~_finite("lat", "lon")).select("lid", F.lit(None).cast(kind).alias("near")))


def nearest(left: DataFrame, right: DataFrame, cell: float | None = None) -> DataFrame:
    """(lid, rid, distance): the nearest right point of each left one by great circle, as in ``nearest_few``;
    null where there is none."""
    first = F.get("near", F.lit(0))
    return nearest_few(left, right, 1, cell).select("lid", first["rid"].alias("rid"), first["d"].alias("distance"))


def nearest_geodesic(left: DataFrame, right: DataFrame, k: int = 8, cell: float | None = None) -> DataFrame:
    """(lid, rid, distance): of the k nearest right points by great circle the one that is nearest on the
    ellipsoid, with that distance. Ties go to the least rid."""
    near = nearest_few(left, right, k, cell)
    pairs = near.select("lid", F.explode("near").alias("n")).select("lid", F.col("n.rid").alias("rid"))
    ends = pairs.join(left.select("lid", F.col("lat").alias("a"), F.col("lon").alias("b")), "lid").join(right.select("rid", F.col("lat").alias("c"), F.col("lon").alias("d")), "rid")
    exact = ends.select("lid", "rid", geodesic(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("g"))
    best = exact.groupBy("lid").agg(F.min(F.struct("g", "rid")).alias("m"))
    return near.select("lid").join(best, "lid", "left").select("lid", F.col("m.rid").alias("rid"), F.col("m.g").alias("distance"))


def point_in_polygon(points: DataFrame, polygons: DataFrame, size: float = 1.0) -> DataFrame:
    """(pid, polygon): the first polygon by ``ord`` that holds the point, by the even-odd rule.

    ``polygons`` (polygon, ord, rings: array<array<struct<x,y>>>). Points meet the polygons whose bounding
    box covers their cell, and of these only the edges that reach into their row of cells, as no other
    edge can cross the line through them; crossings are counted per point and polygon.
    """
    ring = polygons.select("polygon", "ord", F.posexplode("rings").alias("part", "ring"))
    edges = ring.select("polygon", "ord", F.explode(F.zip_with("ring", F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("e"))
    box = edges.groupBy("polygon", "ord").agg(F.min(F.least("e.a.x", "e.b.x")).alias("x0"), F.max(F.greatest("e.a.x", "e.b.x")).alias("x1"), F.min(F.least("e.a.y", "e.b.y")).alias("y0"), F.max(F.greatest("e.a.y", "e.b.y")).alias("y1"))
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
    cells = box.select("*", F.explode(span("x0", "x1")).alias("cx")).select("*", F.explode(span("y0", "y1")).alias("cy"))
    inside_box = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    placed = points.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)}).join(cells, ["cx", "cy"]).filter(inside_box)
    in_rows = edges.select("*", F.explode(F.sequence(F.floor(F.least("e.a.y", "e.b.y") / size), F.floor(F.greatest("e.a.y", "e.b.y") / size))).alias("cy"))
    met = placed.select("pid", "x", "y", "polygon", "ord", "cy").join(in_rows, ["polygon", "ord", "cy"])
    a, b = F.col("e.a"), F.col("e.b")
    straddles = (a["y"] > F.col("y")) != (b["y"] > F.col("y"))
    left_of = F.col("x") < F.try_divide((b["x"] - a["x"]) * (F.col("y") - a["y"]), b["y"] - a["y"]) + a["x"]
    odd = met.groupBy("pid", "polygon", "ord").agg((F.count_if(straddles & left_of) % 2).alias("odd")).filter("odd = 1")
    return odd.groupBy("pid").agg(F.min_by("polygon", "ord").alias("polygon"))


def nearest_assigned(points: DataFrame, assigned: DataFrame) -> DataFrame:
    """(pid, polygon, source): points without a polygon take that of the nearest point that has one."""
    joined = checkpointed(points.join(assigned, "pid", "left"))
    have = joined.filter("polygon IS NOT NULL")
    lack = joined.filter("polygon IS NULL").select(F.col("pid").alias("lid"), F.col("y").alias("lat"), F.col("x").alias("lon"))
    near = nearest(lack, have.select(F.col("pid").alias("rid"), F.col("y").alias("lat"), F.col("x").alias("lon")))
    borrowed = near.join(have.select(F.col("pid").alias("rid"), "polygon"), "rid").select(F.col("lid").alias("pid"), "polygon", F.lit("nearest").alias("source"))
    return have.select("pid", "polygon", F.lit("inside").alias("source")).unionByName(borrowed)


def polygon_centroid(polygons: DataFrame) -> DataFrame:
    """(polygon, area, x, y): shoelace area, and the centroid weighted by absolute ring area."""
    ring = polygons.select("polygon", F.posexplode("rings").alias("part", "ring"))
    edges = ring.select("polygon", "part", F.explode(F.zip_with("ring", F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("e"))
    cross = F.col("e.a.x") * F.col("e.b.y") - F.col("e.b.x") * F.col("e.a.y")
    parts = edges.groupBy("polygon", "part").agg(F.sum(cross).alias("s"), F.sum((F.col("e.a.x") + F.col("e.b.x")) * cross).alias("mx"), F.sum((F.col("e.a.y") + F.col("e.b.y")) * cross).alias("my"))
    parts = parts.select("polygon", F.abs(F.col("s") / 2).alias("area"), F.try_divide("mx", F.col("s") * 3).alias("cx"), F.try_divide("my", F.col("s") * 3).alias("cy"))
    total = F.sum("area")
    return parts.groupBy("polygon").agg(total.alias("area"), F.try_divide(F.sum(F.col("area") * F.col("cx")), total).alias("x"), F.try_divide(F.sum(F.col("area") * F.col("cy")), total).alias("y"))


def knn_edges(points: DataFrame, k: int, cell: float, part: list[str]) -> DataFrame:
    """(src, dst, distance): the k nearest other points (id, x, y) within each ``part``.

    Different places are compared, not points: all points of a place choose from one list of the k + 1 points nearest to it, which
    stand at the k + 1 first places by distance and least id. Only cells within reach are met, as wide as some points
    of a part need and ``cell`` at most, and the reach doubles for places that lack k + 1 points surely
    nearer than it. Ties go to the least id. Points without an id or a coordinate have no edges; of rows of one
    id and part the one with the least place counts.
    """
    spot, x, y = spare("spot", part), spare("x", part), spare("y", part)
    points = points.filter(F.col("id").isNotNull() & _finite("x", "y")).groupBy("id", *part).agg(F.min(F.struct("x", "y")).alias(spot)).select("id", F.col(f"{spot}.x").alias(x), F.col(f"{spot}.y").alias(y), *part)
    points = points.filter(_all_there(part))
    few = points.withColumn("_place", F.row_number().over(Window.partitionBy(x, y, *part).orderBy("id"))).filter(F.col("_place") <= k + 1)
    spots = stored(few.groupBy(x, y, *part).agg(F.sort_array(F.collect_list("id")).alias("_ids")))
    sizes = checkpointed(spots.groupBy(*part).agg(F.sum(F.size("_ids")).alias("_there"), F.count(F.lit(1)).alias("_spots")))
    widest = sizes.agg(F.max("_spots").alias("n")).first()
    reach = cell
    if widest.n:  # a circle of the reach holds some 1.5 k places of the fullest part, if parts lie alike
        anywhere = checkpointed(spots.select(x, y).distinct())
        reach = min(cell, _width(anywhere, x, y, cell / 1024, cell) * ((k + 1) / 2 * anywhere.count() / widest.n) ** 0.5)
    todo, done = spots.select(x, y, *part), None
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        probe = todo.join(sizes, part).select(F.col(x).alias("_sx"), F.col(y).alias("_sy"), "_there", *part, F.explode(_near_cells(F.col(x), F.col(y), reach, 1)).alias("_c")).repartition(tasks, "_c", *part)
        held = spots.select(F.col(x).alias("_dx"), F.col(y).alias("_dy"), "_ids", *part, _dealt(x, y, reach).alias("_c"))
        met = probe.join(held, ["_c", *part]).withColumn("distance", F.sqrt(F.pow(F.col("_sx") - F.col("_dx"), 2) + F.pow(F.col("_sy") - F.col("_dy"), 2)))
        met = met.filter(F.col("distance") <= reach)
        place = Window.partitionBy("_sx", "_sy", *part).orderBy("distance", F.get("_ids", F.lit(0)))
        top = met.select("_sx", "_sy", "_there", *part, "distance", "_ids").withColumn("_at", F.row_number().over(place)).filter(F.col("_at") <= k + 1)
        each = F.transform("_ids", lambda i: F.struct(F.col("distance").alias("distance"), i.alias("dst")))
        near = F.slice(F.sort_array(F.flatten(F.collect_list(each))), 1, k + 1).alias("_near")
        listed = stored(top.groupBy("_sx", "_sy", "_there", *part).agg(near))
        full = (F.size("_near") == k + 1) | (F.size("_near") == F.col("_there"))
        settled = listed.filter(full).select(F.col("_sx").alias(x), F.col("_sy").alias(y), "_near", *part)
        done = settled if done is None else done.unionByName(settled)
        todo = stored(listed.filter(~full).select(F.col("_sx").alias(x), F.col("_sy").alias(y), *part))
        if todo.isEmpty():
            break
        reach *= 2
    own = points.join(done, [x, y, *part]).select(F.col("id").alias("src"), F.slice(F.filter("_near", lambda n: n["dst"] != F.col("id")), 1, k).alias("_near"))
    return own.select("src", F.explode("_near").alias("_n")).select("src", "_n.dst", "_n.distance")


def _all_there(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def global_moran(values: DataFrame, edges: DataFrame, part: list[str]) -> DataFrame:
    """(part.., moran): Moran's I of values (id, v) over edges (src, dst, w); null without variance."""
    mean = values.groupBy(*part).agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"), F.var_pop("v").alias("var"))
    dev = values.join(mean, part).select(*part, "id", (F.col("v") - F.col("m")).alias("d"))
    met = edges.join(dev.withColumnsRenamed({"id": "src", "d": "di"}), "src").join(dev.select(F.col("id").alias("dst"), F.col("d").alias("dj")), "dst")
    sums = met.groupBy(*part).agg(F.sum("w").alias("W"), F.sum(F.col("w") * F.col("di") * F.col("dj")).alias("c"))
    out = sums.join(mean, part)
    ok = (F.col("n") >= 3) & (F.col("var") > 0) & (F.col("W") > 0)
    return out.select(*part, F.when(ok, F.col("c") / (F.col("W") * F.col("var"))).alias("moran"))


def moran_permutations(values: DataFrame, edges: DataFrame, part: list[str], permutations: int = 99, seed: int = 1) -> DataFrame:
    """(part.., moran, expected, z_perm, p): Moran's I of values (id, v), its expectation -1 / (n - 1), its
    distance from the mean of random relabelings in their standard deviations, and the two-sided
    pseudo p-value: the share of relabelings at least as far from the expectation, itself included.

    A relabeling gives every id the value at its rank in an order by a seeded hash; all of them are
    built at once by a join on (part, permutation, rank). Ranks are counted over ranges, so no part is
    ordered or gathered in one task.
    """
    ordered = ranked(values.select(*part, "id", "v"), part, ["id"]).withColumnRenamed("rank", "r")
    runs = ordered.select(*part, "id", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("run"))
    runs = runs.withColumn("h", F.md5(F.concat_ws("|", F.col("id").cast("string"), F.col("run").cast("string"), F.lit(str(seed)))))
    drawn = ranked(runs, [*part, "run"], ["h", "id"]).withColumnRenamed("rank", "r").select(*part, "run", "id", "r").join(ordered.select(*part, "r", "v"), [*part, "r"])
    drawn = drawn.select(*part, "run", "id", "v").unionByName(ordered.select(*part, F.lit(0).alias("run"), "id", "v"))
    all_edges = edges.select("*", F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("run"))
    each = checkpointed(global_moran_runs(drawn, all_edges, part))
    sizes = values.groupBy(*part).agg(F.count(F.lit(1)).alias("n"))
    observed = each.filter("run = 0").join(sizes, part).select(*part, F.col("moran").alias("observed"), F.try_divide(F.lit(-1.0), F.col("n") - 1).alias("expected"))
    met = each.filter("run > 0").join(observed, part)
    # sums are rounded differently in each order: what differs by less is equal
    far = F.abs(F.col("moran") - F.col("expected")) >= F.abs(F.col("observed") - F.col("expected")) - ROUNDING
    sums = met.groupBy(*part).agg(F.first("observed").alias("o"), F.first("expected").alias("e"), F.avg("moran").alias("m"), F.stddev_samp("moran").alias("s"), F.count_if(far).alias("far"), F.count("moran").alias("runs"))
    return sums.select(*part, F.col("o").alias("moran"), F.col("e").alias("expected"), F.when(F.col("s") > ROUNDING, (F.col("o") - F.col("m")) / F.col("s")).alias("z_perm"), ((F.col("far") + 1) / (F.col("runs") + 1)).alias("p"))


def global_moran_runs(values: DataFrame, edges: DataFrame, part: list[str]) -> DataFrame:
    keys = [*part, "run"]
    mean = values.groupBy(*keys).agg(F.avg("v").alias("m"), F.var_pop("v").alias("var"))
    dev = values.join(mean, keys).select(*keys, "id", (F.col("v") - F.col("m")).alias("d"))
    met = edges.join(dev.withColumnsRenamed({"id": "src", "d": "di"}), ["src", "run"]).join(dev.select("run", F.col("id").alias("dst"), F.col("d").alias("dj")), ["dst", "run"])
    return met.groupBy(*keys).agg(F.sum("w").alias("W"), F.sum(F.col("w") * F.col("di") * F.col("dj")).alias("c")).join(mean, keys).select(*keys, F.try_divide("c", F.col("W") * F.col("var")).alias("moran"))


def getis_ord(values: DataFrame, edges: DataFrame, part: list[str]) -> DataFrame:
    """(id, z): Getis-Ord Gi* with binary weights that include the point itself."""
    whole = values.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    own = values.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    near = edges.select("src", "dst").union(own).distinct()
    local = near.join(values.select(F.col("id").alias("dst"), "v"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("v").alias("sum"), F.count(F.lit(1)).alias("w"))
    met = local.join(values.select("id", *part), "id").join(whole, part)
    spread = F.col("s") * F.sqrt(F.try_divide(F.col("n") * F.col("w") - F.col("w") * F.col("w"), F.col("n") - 1))
    return met.select("id", *part, F.try_divide(F.col("sum") - F.col("m") * F.col("w"), spread).alias("z"))

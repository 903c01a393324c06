"""Readers of registers, notices and archives. All take schemas; nothing is inferred from data."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; blank lines are skipped, anything else that isn't an object, and any member
    of another type than the schema's, fails the read."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    is_object = F.col("value").rlike(r"^\s*\{.*\}\s*$") & F.try_parse_json("value").isNotNull()
    checked = F.when(is_object, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("not an object: "), F.substring("value", 1, 80))))
    return parsed.select(checked.alias("r")).select("r.*")


def event_bundles(spark: SparkSession, root: str, schema: str, excluded: list[str]) -> tuple[DataFrame, DataFrame]:
    """Events of all ``<root>/<coverage_date>/events.jsonl`` with their date, and a report of the
    excluded dates that were there, with row counts: they are named, never dropped in silence. A line
    that doesn't fit the schema fails the read."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{root}/*/events.jsonl").withColumn("coverage_date", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/events\.jsonl$", 1))
    out = F.col("coverage_date").isin(*excluded) if excluded else F.lit(False)
    return rows.filter(~out), rows.filter(out).groupBy("coverage_date").agg(F.count(F.lit(1)).alias("rows"))


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """Delimited text, plain or gzipped; a row that doesn't fit the schema fails the read."""
    return spark.read.schema(schema).option("header", header).option("sep", sep).option("mode", "FAILFAST").csv(path)


def zipped_csv(spark: SparkSession, path: str, columns: list[str], skip: int = 0) -> DataFrame:
    """(file, line, <columns>..) of the first .txt or .csv in each ZIP, in cp932 or else UTF-8.

    Columns are found by the codes of the first line; ``skip`` further lines are left out. A file is
    one task's work, so archives should be of the usual per-region size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv as reader

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    member = next(n for n in sorted(z.namelist()) if n.lower().endswith((".txt", ".csv")))
                    raw = z.read(member)
                try:
                    text = raw.decode("cp932")
                except UnicodeDecodeError:
                    text = raw.decode("utf-8")
                rows = reader.reader(io.StringIO(text))
                at = {code: i for i, code in enumerate(next(rows))}
                missing = [c for c in columns if c not in at]
                if missing:
                    raise ValueError(f"{name}: no columns {missing}")
                found = [(i, [r[at[c]] if at[c] < len(r) else None for c in columns]) for i, r in enumerate(rows) if i >= skip]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(found)), pa.array([i for i, _ in found], pa.int32()), *[pa.array([r[j] for _, r in found], pa.string()) for j in range(len(columns))]],
                        names=["file", "line", *columns],
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, ", ".join(["file string", "line int", *[f"`{c}` string" for c in columns]]))


#: Limits on archives: members, bytes of a member, and how far it may expand.
MEMBERS, MEMBER_BYTES, EXPANSION = 10_000, 100 << 20, 200


def archive_problems(spark: SparkSession, path: str) -> DataFrame:
    """(file, member, problem) of ZIP members with unsafe paths, sizes or expansion; nothing is unpacked."""
    schema = "file string, member string, problem string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    infos = z.infolist()
                if len(infos) > MEMBERS:
                    found.append((name, None, "too_many_members"))
                for i in infos:
                    if i.filename.startswith(("/", "\\")) or ".." in i.filename.replace("\\", "/").split("/"):
                        found.append((name, i.filename, "unsafe_path"))
                    if i.file_size > MEMBER_BYTES:
                        found.append((name, i.filename, "too_large"))
                    if i.file_size > EXPANSION * max(1, i.compress_size):
                        found.append((name, i.filename, "expansion"))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], names=["file", "member", "problem"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def _shape_records(name: str, data: bytes) -> Iterator[tuple[int, bytes]]:
    """(number, content) of the records of a shapefile."""
    if len(data) < 100 or struct.unpack(">i", data[:4])[0] != 9994 or 2 * struct.unpack(">i", data[24:28])[0] != len(data):
        raise ValueError(f"{name}: not a whole shapefile")
    at = 100
    while at < len(data):
        number, words = struct.unpack(">ii", data[at : at + 8])
        yield number, data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words


def _points_of(name: str, data: bytes) -> list[tuple[float, float]]:
    found = []
    for number, body in _shape_records(name, data):
        if len(body) != 20 or struct.unpack("<i", body[:4])[0] != 1:
            raise ValueError(f"{name}: record {number} is no point")
        found.append(struct.unpack("<dd", body[4:]))
    return found


def shape_points(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, x, y) of the points in shapefiles (.shp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(name, i, x, y) for i, (x, y) in enumerate(_points_of(name, data))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["file", "ord", "x", "y"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, ord long, x double, y double")


def shape_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, rings) of the polygons in shapefiles, in the form that the spatial operators take: every
    part is a ring without its closing point. Records without a shape, or of fewer than four points, are left out."""
    ring = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names, places, shapes = [], [], []
                for number, body in _shape_records(name, data):
                    kind = struct.unpack("<i", body[:4])[0]
                    if kind == 0:
                        continue
                    if kind != 5:
                        raise ValueError(f"{name}: record {number} is no polygon")
                    parts, points = struct.unpack("<ii", body[36:44])
                    starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
                    numbers = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
                    if points >= 4:
                        at = [{"x": numbers[2 * i], "y": numbers[2 * i + 1]} for i in range(points)]
                        names.append(name)
                        places.append(number - 1)
                        shapes.append([at[i : j - 1] if at[i] == at[j - 1] else at[i:j] for i, j in zip(starts, starts[1:])])
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(places, pa.int64()), pa.array(shapes, ring)], names=["file", "ord", "rings"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, ord long, rings array<array<struct<x:double,y:double>>>")


#: Fields that an office of a facility archive must have.
OFFICE_FIELDS = ("position", "administrativeArea", "publicFacilityLargeClassification", "publicFacilitySmallClassification", "type", "name", "address", "administrativeCode")


def facility_archive(spark: SparkSession, path: str, crs: str = "JGD2000", tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Offices with their points from ZIP archives of one XML, SHP, DBF and PRJ each, and their problems.

    Offices: (file, office, point, fields, lat, lon). Problems: (file, id, problem): member_missing,
    crs_unexpected, duplicate_point, invalid_point, duplicate_office, missing_required_field,
    unresolved_point, and where the parts disagree dbf_xml_count_mismatch, shp_xml_count_mismatch and
    shp_xml_coordinate_mismatch (points in order, within the tolerance). An archive is one task's work;
    offices of a faulty archive come out, too.
    """
    import json

    names = ["file", "kind", "id", "ord", "x", "y", "fields"]
    shape = pa.schema([("file", pa.string()), ("kind", pa.string()), ("id", pa.string()), ("ord", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("fields", pa.string())])

    def members(name: str, data: bytes) -> Iterator[tuple]:
        from xml.etree import ElementTree

        local = lambda tag: tag.rsplit("}", 1)[-1]
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            by_kind = {i.filename.rsplit(".", 1)[-1].lower(): i for i in z.infolist() if not i.is_dir()}
            for kind in ("xml", "shp", "dbf", "prj"):
                if kind not in by_kind or by_kind[kind].file_size > MEMBER_BYTES:
                    yield name, "member_missing", kind, None, None, None, None
            if "prj" in by_kind and crs not in z.read(by_kind["prj"]).decode("utf-8", "replace"):
                yield name, "crs_unexpected", None, None, None, None, None
            if "dbf" in by_kind:
                yield name, "dbf", None, struct.unpack("<I", z.read(by_kind["dbf"])[4:8])[0], None, None, None
            if "shp" in by_kind:
                for i, (x, y) in enumerate(_points_of(name, z.read(by_kind["shp"]))):
                    yield name, "shp", None, i, x, y, None
            counts = {"Point": 0, "PostOffice": 0}
            if "xml" in by_kind:
                with z.open(by_kind["xml"]) as stream:
                    for _, element in ElementTree.iterparse(stream):
                        kind = local(element.tag)
                        if kind not in counts:
                            continue
                        own = next((v for k, v in element.attrib.items() if local(k) == "id"), None)
                        if kind == "Point":
                            text = next((c.text or "" for c in element if local(c.tag) == "pos"), "").split()
                            try:
                                y, x = map(float, text)
                                good = -90 <= y <= 90 and -180 <= x <= 180
                            except ValueError:
                                good = False
                            yield name, "point", own, counts[kind], x if good else None, y if good else None, None
                        else:
                            cells = {local(c.tag): next((v for k, v in c.attrib.items() if local(k) == "href"), None) or (c.text or "").strip() for c in element}
                            yield name, "office", own, counts[kind], None, None, json.dumps(cells, ensure_ascii=False)
                        counts[kind] += 1
                        element.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(members(name, data))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], shape)

    from netledger.session import stored

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = stored(files.mapInArrow(run, "file string, kind string, id string, ord long, x double, y double, fields string"))
    of = lambda kind: rows.filter(F.col("kind") == kind)
    once = lambda d: d.groupBy("file", "id").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    points, offices = of("point"), of("office").withColumn("fields", F.from_json("fields", "map<string,string>"))
    point_ids, office_ids = once(points), once(offices)
    problem = lambda d, code, id_column="id": d.select("file", F.col(id_column).cast("string").alias("id"), F.lit(code).alias("problem"))
    known = points.join(point_ids.filter("n = 1 AND id IS NOT NULL").select("file", "id"), ["file", "id"])
    unique = offices.join(office_ids.filter("n = 1 AND id IS NOT NULL").select("file", "id"), ["file", "id"])
    lacking = F.exists(F.array(*[F.coalesce(F.trim(F.col("fields")[f]), F.lit("")) for f in OFFICE_FIELDS]), lambda v: F.ltrim(v, F.lit("#")) == "")
    whole = unique.filter(~lacking).withColumn("point", F.ltrim(F.col("fields")["position"], F.lit("#")))
    met = whole.select("file", F.col("id").alias("office"), "point", "fields").join(known.filter("x IS NOT NULL").select("file", F.col("id").alias("point"), F.col("y").alias("lat"), F.col("x").alias("lon")), ["file", "point"], "left")
    counts = rows.groupBy("file").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("shp", "point", "office")], F.max(F.when(F.col("kind") == "dbf", F.col("ord"))).alias("dbf"))
    far = F.greatest(F.abs(F.col("p.x") - F.col("s.x")), F.abs(F.col("p.y") - F.col("s.y"))) > tolerance
    moved = points.alias("p").join(of("shp").alias("s"), ["file", "ord"]).filter(far).select("file", F.col("p.id").alias("id"))
    found = [
        problem(of("member_missing"), "member_missing"), problem(of("crs_unexpected"), "crs_unexpected"), problem(point_ids.filter("n > 1 OR id IS NULL"), "duplicate_point"), problem(office_ids.filter("n > 1 OR id IS NULL"), "duplicate_office"),
        problem(known.filter("x IS NULL"), "invalid_point"), problem(unique.filter(lacking), "missing_required_field"), problem(met.filter("lat IS NULL"), "unresolved_point", "office"), problem(moved, "shp_xml_coordinate_mismatch"),
        problem(counts.filter("dbf <> office").withColumn("id", F.lit(None)), "dbf_xml_count_mismatch"), problem(counts.filter("shp <> office OR shp <> point").withColumn("id", F.lit(None)), "shp_xml_count_mismatch"),
    ]
    problems = found[0]
    for f in found[1:]:
        problems = problems.unionByName(f)
    return met.filter("lat IS NOT NULL").select("file", "office", "point", "fields", "lat", "lon"), problems


def polygons(spark: SparkSession, path: str, schema: str = "polygon string, ord int, rings array<array<struct<x:double,y:double>>>") -> DataFrame:
    """Polygons as JSON lines in the form that the spatial operators take."""
    return jsonl(spark, path, schema)


def notice_changes(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, day, reason, before, after, problem) of change notices.

    Notices are texts in which a line of 変更前, one with a date and a reason, and one of 変更後
    follow each other. Lines that don't pair are reported. Pairing looks at neighbouring lines only, so
    it is a window over the lines of a file, not a parser state.
    """
    from pyspark.sql import Window

    from netledger.functions.text import era_date

    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = texts.select("file", F.posexplode(F.split("value", "\n")).alias("line", "text")).filter(F.trim("text") != "")
    w = Window.partitionBy("file").orderBy("line")
    dated = F.regexp_extract(F.lead("text", 1).over(w), r"^\s*([RHS]?[0-9]{1,4}\.[0-9]{1,2}\.[0-9]{1,2})\s+(.*?)\s*$", 1)
    why = F.regexp_extract(F.lead("text", 1).over(w), r"^\s*([RHS]?[0-9]{1,4}\.[0-9]{1,2}\.[0-9]{1,2})\s+(.*?)\s*$", 2)
    rest = lambda c, word: F.trim(F.regexp_extract(c, rf"^\s*{word}\s+(.*)$", 1))
    found = lines.select("file", "line", "text", dated.alias("d"), why.alias("reason"), F.lead("text", 2).over(w).alias("second"))
    starts = found.filter(F.ltrim("text").startswith("変更前"))
    paired = F.coalesce(F.ltrim("second").startswith("変更後"), F.lit(False)) & (F.col("d") != "")
    day = F.when(paired, era_date(F.col("d")))
    return starts.select(
        "file", "line", day.alias("day"), F.when(paired, F.col("reason")).alias("reason"), rest(F.col("text"), "変更前").alias("before"), F.when(paired, rest(F.col("second"), "変更後")).alias("after"),
        F.when(~paired, "unpaired").when(day.isNull(), "bad_date").alias("problem"),
    )


def register_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, line, section, serial, official_identifier, rest, status) of register lists.

    Pages end in form feeds; a line ``【name】`` names the section of the rows after it, and a row is
    serial, identifier, text and status. The section is carried forward by a window over the file.
    """
    from pyspark.sql import Window

    from netledger.functions.text import official_id

    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    pages = texts.select("file", F.posexplode(F.split("value", "\f")).alias("page", "body"))
    lines = pages.select("file", "page", F.posexplode(F.split("body", "\n")).alias("line", "text"))
    w = Window.partitionBy("file").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    section = F.last(F.nullif(F.regexp_extract("text", r"^\s*【(.+?)】\s*$", 1), F.lit("")), ignorenulls=True).over(w)
    p = r"^\s*([0-9]+)\s+([0-9]{6}[A-Za-z]?)\s+(.*?)\s+(営業中|一時閉鎖)\s*$"
    part = lambda i: F.regexp_extract("text", p, i)
    return lines.withColumn("section", section).filter(F.col("text").rlike(p)).select(
        "file", "page", "line", "section", part(1).cast("int").alias("serial"), official_id(part(2)).alias("official_identifier"), part(3).alias("rest"), part(4).alias("status")
    )


def dbf_rows(spark: SparkSession, path: str, fields: list[tuple[str, str, int]]) -> DataFrame:
    """(file, ord, <fields>..) of dBASE tables with exactly the fields (name, type, length), as text in
    cp932; deleted rows are left out, and any other layout fails the read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count, head, width = struct.unpack("<IHH", data[4:12])
                there = [(data[i : i + 11].split(b"\0")[0].decode("ascii"), chr(data[i + 11]), data[i + 16]) for i in range(32, head - 1, 32)]
                if there != list(map(tuple, fields)) or width != 1 + sum(n for _, _, n in there):
                    raise ValueError(f"{name}: fields are {there}")
                rows = []
                for r in range(count):
                    at = head + r * width
                    if data[at : at + 1] == b" ":
                        at, cells = at + 1, []
                        for _, _, n in there:
                            cells.append(data[at : at + n].decode("cp932").strip())
                            at += n
                        rows.append((name, r, *cells))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["file", "ord", *[f for f, _, _ in fields]])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, ", ".join(["file string", "ord long", *[f"`{f}` string" for f, _, _ in fields]]))


def referenced_points(spark: SparkSession, path: str, point_tag: str, office_tag: str) -> tuple[DataFrame, DataFrame]:
    """(offices with their point, problems) of XML in which offices refer to points by ``position``.

    Points are ``<tag id=..><pos>lat lon</pos></tag>``, offices ``<tag id=..><name>..<position>#id``.
    Points and offices whose id occurs twice, and references to no point, are reported.
    """
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    points = read(point_tag, "_id string, pos string").select(F.col("_id").alias("point"), F.split_part("pos", F.lit(" "), F.lit(1)).cast("double").alias("lat"), F.split_part("pos", F.lit(" "), F.lit(2)).cast("double").alias("lon"))
    offices = read(office_tag, "_id string, name string, position string").select(F.col("_id").alias("office"), "name", F.ltrim("position", F.lit("#")).alias("point"))
    twice = lambda d, c: d.groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(c)
    bad_points, bad_offices = twice(points, "point"), twice(offices, "office")
    met = offices.join(bad_offices, "office", "left_anti").join(points.join(bad_points, "point", "left_anti"), "point", "left")
    problems = bad_points.select(F.col("point").alias("id"), F.lit("duplicate_point").alias("problem")).union(bad_offices.select("office", F.lit("duplicate_office"))).union(met.filter("lat IS NULL").select("office", F.lit("no_point")))
    return met.filter("lat IS NOT NULL").select("office", "name", "lat", "lon"), problems

"""WARC archives of web pages and a Merkle audit of their replicas.

Pages become WARC/1.1 resource records. A record's identity is its WARC-Record-ID; within an archive
records stand in order of identity, and the archive is chosen by hash, so archives are of equal size
and a range of identities is a range of offsets. An index row (archive, offset, length, record_id,
page_id, uri, digest) is taken from the stored files of a replica, each on its own.

The audit builds a tree per archive over these ranges: the 256 ranges of the first two hex digits of
the identity, 16 ranges above them, and the root. A range's hash covers identity, length and digest of
its records in order of their offsets, but no absolute offset, so a record that is lost, added or of
another length changes its own branch only. Replicas compare their roots; only below mismatching nodes
are the next level's nodes looked at, down to the records. A record that one replica lacks is
``missing`` or ``extra``, one that differs is ``corrupt``; a range of equal records in another order is
``reordered``.

Files may be plain or of gzip members, with any record types and header fields. Where a header is
unreadable or a length is wrong, the stretch up to the next record counts as one record, so damage
doesn't spread. A file is one row when read, which bounds it to 2 GB; files written here hold
ARCHIVE_RECORDS records on average. A null url or html is empty in the record, and pages equal in all
columns share one record. An empty table has no archives.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from netledger.llm.common import table
from netledger.session import checkpointed, fresh_path, stored

END = "\r\n\r\n"
#: Records of an archive on average, and those that a task hands on at a time.
ARCHIVE_RECORDS, ROWS = 8192, 256
#: Hex digits of the identity at each level of the tree, from the lowest up to the root.
LEVELS = (2, 1, 0)

_PLACE = r"([0-9a-fA-F]{8})-[0-9a-fA-F-]+$"


def resources(pages: DataFrame) -> DataFrame:
    """(archive, key, page_id, url, html) of the different rows of ``pages`` (page_id, url, html)."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    key = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, html))
    archives = max(1, -(-pages.count() // ARCHIVE_RECORDS))
    rows = pages.select("page_id", F.regexp_replace(url, r"[\r\n]+", " ").alias("url"), html.alias("html"), key.alias("key"))
    archive = (F.conv(F.substring("key", 25, 8), 16, 10).cast("long") % archives).cast("string").alias("archive")
    # equal pages are of one archive, so one shuffle serves to find them and to write the archives
    return rows.select(archive, "key", "page_id", "url", "html").repartition("archive").dropDuplicates(["archive", "key"])


def record() -> Column:
    """The WARC record of a row of ``resources``, without the blank lines that end it."""
    uuid = F.concat_ws("-", *[F.substring("key", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    page = F.coalesce(F.concat(F.lit("\r\nX-Page-ID: "), F.col("page_id").cast("string")), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), "url", page,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END), "html",
    )


def laid(rows: DataFrame, whole: bool = False) -> DataFrame:
    """(archive, value): the records of rows of ``resources``, an archive in one partition and in order of identity.
    ``whole`` says that no archive lies in several partitions, so that nothing is shuffled."""
    return (rows if whole else rows.repartition("archive")).sortWithinPartitions("archive", "key").select("archive", record().alias("value"))


def write(rows: DataFrame, path: str, compression: str = "gzip", whole: bool = False) -> None:
    """Write rows of ``resources`` as one file per archive, in folders archive=.., in order of identity."""
    laid(rows, whole).write.partitionBy("archive").option("lineSep", END).option("compression", compression).text(path)


def inflated(data: bytes, step: int = 1 << 20) -> bytes:
    """What a file of gzip members holds, up to the first damage; other files as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, at, member = [], 0, zlib.decompressobj(31)
    while at < len(data):
        try:
            out.append(member.decompress(data[at : at + step]))
        except zlib.error:
            break
        at += step
        if member.eof:
            at = min(at, len(data)) - len(member.unused_data)
            member = zlib.decompressobj(31)
    return b"".join(out)


def parsed(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, fields, body) of the records of a WARC file; field names in lower case."""
    end = END.encode()
    at = 0
    while at < len(data):
        stop = data.find(end, at)
        stop = len(data) if stop < 0 else stop
        fields: dict[str, str] = {}
        for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if colon and not line[:1].isspace():
                fields[name.strip().lower()] = value.strip()
        size, body = fields.get("content-length", ""), stop + len(end)
        upto = body + int(size) if size.isascii() and size.isdigit() else -1
        if upto < 0 or not data.startswith(b"WARC/", at) or data[upto : upto + len(end)] != end:
            following = data.find(end + b"WARC/", at + 1)
            upto = following if following >= 0 else max(body, len(data) - len(end))
        yield at, min(upto + len(end), len(data)) - at, fields, data[body:upto]
        at = upto + len(end)


def _scanned(spark: SparkSession, path: str, schema: str, row, swapped: Callable[[dict[str, str]], bool] | None = None) -> DataFrame:
    """Rows that ``row`` makes of the records of the files of a folder. Records whose fields ``swapped`` holds for
    exchange their last columns two by two, in order of the file; an odd one keeps its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                archive, data, rows, waiting = name.as_py(), inflated(content.as_py()), [], None
                for offset, length, fields, body in parsed(data):
                    made = (archive, offset, length, *row(fields, body, data[offset : offset + length]))
                    if swapped and swapped(fields):
                        if waiting is None:
                            waiting = made
                            continue
                        rows.append((*waiting[:-1], made[-1]))
                        made, waiting = (*made[:-1], waiting[-1]), None
                    rows.append(made)
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], shape)
                        rows = []
                rows += [waiting] if waiting else []
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], shape)

    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64()}
    shape = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    own = F.nullif(F.regexp_extract("path", r"/archive=([^/]+)/", 1), F.lit(""))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.coalesce(own, F.regexp_extract("path", "([^/]+)$", 1)), "content").mapInArrow(run, schema)


def _identity(fields: dict[str, str]) -> tuple[str | None, int | None, str | None]:
    page = fields.get("x-page-id", "")
    return fields.get("warc-record-id", "").strip("<>") or None, int(page) if page.lstrip("-").isdigit() else None, fields.get("warc-target-uri")


def index(spark: SparkSession, path: str) -> DataFrame:
    """(archive, offset, length, record_id, page_id, uri, digest) of all records in the files of a folder."""
    schema = "archive string, offset long, length long, record_id string, page_id long, uri string, digest string"
    return _scanned(spark, path, schema, lambda fields, body, whole: (*_identity(fields), hashlib.sha256(whole).hexdigest()))


def read(spark: SparkSession, path: str, swapped: Callable[[dict[str, str]], bool] | None = None) -> DataFrame:
    """(archive, offset, length, record_id, page_id, url, type, html) of all records; the body as text. Records
    that ``swapped`` holds for by their fields exchange their bodies two by two."""
    schema = "archive string, offset long, length long, record_id string, page_id long, url string, type string, html string"
    return _scanned(spark, path, schema, lambda fields, body, whole: (*_identity(fields), fields.get("warc-type"), body.decode("utf-8", "replace")), swapped)


def _hash(entries: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.sort_array(entries), lambda e: e["entry"]), ","), 256)


def tree(index: DataFrame) -> list[DataFrame]:
    """Levels of (archive, place, at, entry), from the records up to the roots."""
    own = F.nullif(F.lower(F.regexp_extract("record_id", _PLACE, 1)), F.lit(""))
    identity = F.coalesce("record_id", F.lit(""))
    levels = [index.select("archive", F.coalesce(own, F.md5(identity)).alias("place"), F.col("offset").alias("at"), F.concat_ws(":", identity, "length", "digest").alias("entry"))]
    for digits in LEVELS:
        place = F.substring("place", 1, digits).alias("place")
        nodes = levels[-1].groupBy("archive", place).agg(F.min("at").alias("at"), _hash(F.collect_list(F.struct("at", "entry"))).alias("entry"))
        levels.append(checkpointed(nodes))
    return levels


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Compare two indexes: one row per archive with both roots, and one per record that differs.

    (archive, level, status, record_id, page_id, a, b, a_offset, b_offset, a_length, b_length): level is
    ``archive``, ``range`` or ``record``; a and b are hashes, null where that replica has none. Of records
    with one identity in an archive, the first are compared with the first, and so on.
    """
    left, right = tree(a), tree(b)
    roots, open_nodes = None, None
    for x, y, digits in zip(reversed(left[1:]), reversed(right[1:]), reversed(LEVELS)):
        if open_nodes is not None:
            under = lambda d: d.withColumn("parent", F.substring("place", 1, above)).join(open_nodes, ["archive", "parent"], "left_semi")  # noqa: B023, E731
            x, y = under(x), under(y)
        met = x.alias("x").join(y.alias("y"), ["archive", "place"], "full").select("archive", "place", F.col("x.entry").alias("a"), F.col("y.entry").alias("b"), F.col("x.at").alias("a_offset"), F.col("y.at").alias("b_offset"))
        if roots is None:
            roots = met
        differ = checkpointed(met.filter(~F.col("a").eqNullSafe(F.col("b"))))
        open_nodes, above = differ.select("archive", F.col("place").alias("parent")), digits
    place = F.coalesce(F.nullif(F.lower(F.regexp_extract("record_id", _PLACE, 1)), F.lit("")), F.md5(F.coalesce("record_id", F.lit(""))))
    same = Window.partitionBy("archive", "record_id").orderBy("offset")
    inside = lambda d: d.withColumn("parent", F.substring(place, 1, LEVELS[0])).join(open_nodes, ["archive", "parent"], "left_semi").withColumn("nth", F.row_number().over(same))
    p, q = inside(a).alias("p"), inside(b).alias("q")
    met = p.join(q, (F.col("p.archive") == F.col("q.archive")) & F.col("p.record_id").eqNullSafe(F.col("q.record_id")) & (F.col("p.nth") == F.col("q.nth")), "full")
    met = met.filter(~F.col("p.digest").eqNullSafe(F.col("q.digest")) | ~F.col("p.length").eqNullSafe(F.col("q.length")))
    status = F.when(F.col("q.digest").isNull(), "missing").when(F.col("p.digest").isNull(), "extra").otherwise("corrupt")
    either = lambda c: F.coalesce(f"p.{c}", f"q.{c}").alias(c)
    records = checkpointed(met.select(
        either("archive"), either("parent"), F.lit("record").alias("level"), status.alias("status"), either("record_id"), either("page_id"), F.col("p.digest").alias("a"), F.col("q.digest").alias("b"),
        F.col("p.offset").alias("a_offset"), F.col("q.offset").alias("b_offset"), F.col("p.length").alias("a_length"), F.col("q.length").alias("b_length"),
    ))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("record_id", "string"), ("page_id", "long"))]
    lengths = [F.lit(None).cast("long").alias(c) for c in ("a_length", "b_length")]
    node = lambda d, level, status: d.select("archive", F.lit(level).alias("level"), status.alias("status"), *none, "a", "b", "a_offset", "b_offset", *lengths)
    ordered = differ.withColumn("parent", F.col("place")).join(records, ["archive", "parent"], "left_anti")
    by_archive = node(roots, "archive", F.when(F.col("a").eqNullSafe(F.col("b")), "match").otherwise("mismatch"))
    return by_archive.unionByName(node(ordered, "range", F.lit("reordered"))).unionByName(records.drop("parent"))


def _marked(rows: DataFrame) -> DataFrame:
    """``rows`` with h, 0 to 999 by a hash of the key, which tells the damage."""
    return rows.withColumn("h", F.conv(F.substring(F.md5(F.concat(F.lit("damage"), "key")), 1, 6), 16, 10).cast("long") % 1000)


def _changed(marked: DataFrame) -> DataFrame:
    """Rows with h: some lost, longer, shorter, changed or doubled. Each is made of one row."""
    short = F.expr("substring(html, 1, length(html) - 1)")
    own = F.when(F.col("h").isin(2, 3), F.concat("html", F.lit("<!-- more -->"))).when(F.col("h").isin(4, 5), short).when(F.col("h").isin(6, 7), F.concat(short, F.lit("~"))).otherwise(F.col("html"))
    one, two = F.struct("key", own.alias("html")), F.struct(F.md5(F.concat(F.lit("added"), "key")).alias("key"), F.col("html"))
    copies = F.when(F.col("h").isin(8, 9), F.array(one, two)).otherwise(F.array(one))
    return marked.filter("h NOT IN (0, 1)").select("archive", "page_id", "url", F.explode(copies).alias("c")).select("archive", "c.key", "page_id", "url", "c.html")


def spoilt(rows: DataFrame) -> DataFrame:
    """Rows of ``resources`` with twelve in a thousand records, chosen by hash, lost, longer, shorter,
    changed, doubled under a new identity, or with their contents swapped, two in a thousand each."""
    marked = _marked(rows)
    order = Window.partitionBy("archive").orderBy("key")
    other = F.when(F.row_number().over(order) % 2 == 1, F.lead("html").over(order)).otherwise(F.lag("html").over(order))
    swapped = marked.filter("h IN (10, 11)").select("archive", "key", "page_id", "url", F.coalesce(other, "html").alias("html"))
    return _changed(marked.filter("h NOT IN (10, 11)")).unionByName(swapped)


def spoilt_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``spoilt`` from the files that ``write`` made of them. A file holds an archive in order, so
    contents are swapped where it is read, and no row leaves its partition."""

    def swapped(fields: dict[str, str]) -> bool:
        key = fields["warc-record-id"].strip("<>").removeprefix("urn:uuid:").replace("-", "")
        return int(hashlib.md5(f"damage{key}".encode()).hexdigest()[:6], 16) % 1000 in (10, 11)

    key = F.regexp_replace(F.regexp_extract("record_id", "([0-9a-f-]+)$", 1), "-", "")
    return _changed(_marked(read(spark, path, swapped).select("archive", key.alias("key"), "page_id", "url", "html")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixity drill: the pages are written as archives, and a replica of the stored files with damage of
    all kinds as others. The audit of both from their files must find all of it and nothing else."""
    original, replica = fresh_path(spark), fresh_path(spark)
    write(resources(table(spark, sf_dir, "pages").select("page_id", "url", "html")), original)
    write(spoilt_files(spark, original), replica, whole=True)
    return audit(stored(index(spark, original)), stored(index(spark, replica)))


def _sql() -> str:
    crlf = "chr(13) || chr(10)"
    levels = []
    for side in "ab":
        levels.append(f"{side}0 AS (SELECT archive, key AS place, pos AS p, 'urn:uuid:' || rid || ':' || length || ':' || digest AS entry FROM {side})")
        for k, digits in enumerate(LEVELS):
            levels.append(
                f"{side}{k + 1} AS (SELECT archive, place[1:{digits}] AS place, min(p) AS p, sha256(string_agg(entry, ',' ORDER BY p, entry)) AS entry FROM {side}{k} GROUP BY archive, place[1:{digits}])"
            )
    top = len(LEVELS)
    return rf"""
WITH p AS (
  SELECT DISTINCT page_id, regexp_replace(coalesce(url, ''), '[' || chr(13) || chr(10) || ']+', ' ', 'g') AS url, coalesce(html, '') AS html,
    md5(concat_ws(chr(31), coalesce(page_id::VARCHAR, ''), coalesce(url, ''), coalesce(html, ''))) AS key FROM pages
), n AS (
  SELECT *, (('0x' || key[25:32])::BIGINT % (SELECT greatest(1, ceil(count(*) / {ARCHIVE_RECORDS}))::BIGINT FROM pages))::VARCHAR AS archive,
    ('0x' || md5('damage' || key)[1:6])::BIGINT % 1000 AS h FROM p
), o AS (SELECT *, row_number() OVER w AS nth, lead(html) OVER w AS nxt, lag(html) OVER w AS prv FROM n WHERE h IN (10, 11) WINDOW w AS (PARTITION BY archive ORDER BY key)),
s AS (
  SELECT 'a' AS side, archive, key, page_id, url, html FROM n
  UNION ALL SELECT 'b', archive, key, page_id, url, CASE WHEN h IN (2, 3) THEN html || '<!-- more -->' WHEN h IN (4, 5) THEN html[:-2] WHEN h IN (6, 7) THEN html[:-2] || '~' ELSE html END
    FROM n WHERE h NOT IN (0, 1, 10, 11)
  UNION ALL SELECT 'b', archive, md5('added' || key), page_id, url, html FROM n WHERE h IN (8, 9)
  UNION ALL SELECT 'b', archive, key, page_id, url, coalesce(CASE WHEN nth % 2 = 1 THEN nxt ELSE prv END, html) FROM o
), r AS (
  SELECT side, archive, key, page_id, key[1:8] || '-' || key[9:12] || '-' || key[13:16] || '-' || key[17:20] || '-' || key[21:32] AS rid,
    'WARC/1.1' || {crlf} || 'WARC-Type: resource' || {crlf} || 'WARC-Record-ID: <urn:uuid:' || rid || '>' || {crlf} || 'WARC-Date: 1970-01-01T00:00:00Z' || {crlf} || 'WARC-Target-URI: ' || url
    || coalesce({crlf} || 'X-Page-ID: ' || page_id, '') || {crlf} || 'Content-Type: text/html' || {crlf} || 'Content-Length: ' || strlen(html) || {crlf} || {crlf} || html || {crlf} || {crlf} AS record FROM s
), i AS (
  SELECT side, archive, key, rid, page_id, strlen(record)::BIGINT AS length, sha256(record) AS digest FROM r
), l AS (
  SELECT *, coalesce(sum(length) OVER (PARTITION BY side, archive ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM i
), a AS (SELECT * FROM l WHERE side = 'a'), b AS (SELECT * FROM l WHERE side = 'b'),
{", ".join(levels)}
SELECT coalesce(x.archive, y.archive) AS archive, 'archive' AS level, CASE WHEN x.entry IS NOT DISTINCT FROM y.entry THEN 'match' ELSE 'mismatch' END AS status, NULL::VARCHAR AS record_id,
  NULL::BIGINT AS page_id, x.entry AS a, y.entry AS b, x.p AS a_offset, y.p AS b_offset, NULL::BIGINT AS a_length, NULL::BIGINT AS b_length
FROM a{top} AS x FULL JOIN b{top} AS y ON x.archive = y.archive
UNION ALL
SELECT coalesce(x.archive, y.archive), 'record', CASE WHEN y.digest IS NULL THEN 'missing' WHEN x.digest IS NULL THEN 'extra' ELSE 'corrupt' END, 'urn:uuid:' || coalesce(x.rid, y.rid),
  coalesce(x.page_id, y.page_id), x.digest, y.digest, x.pos, y.pos, x.length, y.length
FROM a AS x FULL JOIN b AS y ON x.archive = y.archive AND x.key = y.key WHERE x.digest IS DISTINCT FROM y.digest"""


SQL = _sql()

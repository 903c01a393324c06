"""The whole geocoding run on addresses whose levels are known."""

from netledger.operators import geocoding as gc

POINTS = "region string, city string, town string, lat double, lon double"


def run(spark, addresses, towns=(), sections=(), blocks=(), cities=()):
    made = spark.createDataFrame([(i, a) for i, a in enumerate(addresses)], "aid int, address string")
    out = gc.geocode(
        made, spark.createDataFrame(list(towns), POINTS), spark.createDataFrame(list(sections), POINTS),
        spark.createDataFrame(list(blocks), "region string, city string, town string, block string, lat double, lon double, deleted boolean"),
        spark.createDataFrame(list(cities), "region string, city string, lat double, lon double"))
    return {r.aid: r for r in out.collect()}


CITIES = [("東京都", c, float(i), float(i)) for i, c in enumerate(("三宅村", "港区", "瑞穂町", "田市", "山島田市"))]


def test_cities_are_found_behind_counties_and_islands(spark):
    found = run(spark, ["東京都三宅島三宅村", "東京都西多摩郡瑞穂町本町", "東京都港区芝", "東京都郡山島田市", "東京都無い市", "港区芝", "", None], cities=CITIES)
    assert [found[i].city for i in range(8)] == ["三宅村", "瑞穂町", "港区", "田市", None, None, None, None]
    assert [found[i].error for i in range(8)] == [None] * 4 + ["no_city"] + ["no_pref"] * 3
    assert [found[i].accuracy for i in range(8)] == ["city"] * 4 + ["unmatched"] * 4


def test_towns_by_every_form_and_blocks_where_written(spark):
    at = lambda *names: [("東京都", "港区", n, 1.0 + i, 2.0) for i, n in enumerate(names)]
    blocks = [("東京都", "港区", "芝二丁目", "7", 10.0, 10.0, False), ("東京都", "港区", "芝二丁目", "7", 12.0, 12.0, None), ("東京都", "港区", "芝二丁目", "7", 99.0, 99.0, True), ("東京都", "港区", "三田", "3", 20.0, 20.0, False)]
    addresses = ["東京都港区芝2-7-1", "東京都港区芝2-8", "東京都港区三田3-1", "東京都港区三田3-1-1", "東京都港区大字三田字小松3", "東京都港区上ル三田", "東京都港区通2東入田丸町3", "東京都港区巻潟", "東京都港区新橋", "東京都港区北"]
    found = run(spark, addresses, at("芝二丁目", "三田", "田丸町"), at("巻", "新橋", "三田"), blocks, CITIES)
    assert [found[i].method for i in range(10)] == ["exact_chome", "exact_chome", "exact", "exact", "prefix", "suffix", "substr", "prefix1", "exact", None]
    assert [found[i].accuracy for i in range(10)] == ["block", "town", "block", "town", "town", "town", "town", "town", "town", "city"]
    assert (found[0].lat, found[2].lat, found[3].lat) == (11.0, 20.0, 2.0)
    assert [found[i].source for i in (0, 7, 8, 9)] == ["towns", "sections", "sections", None]


def test_tables_without_rows(spark):
    assert run(spark, []) == {}
    assert run(spark, ["東京都港区芝2-7"])[0].error == "no_city"

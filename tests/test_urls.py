"""URL lists, predicates, expansion and routing."""

from __future__ import annotations

from urllib.parse import parse_qs, urlparse

import pytest
from conftest import one_col
from pyspark.sql import functions as F

from tessera.functions import fixed_values as fv
from tessera.functions import urls as U
from tessera.operators import expansion
from tessera.session import scratch_path
from tessera.sources import url_list

URLS = [
    "https://www.bilibili.com/video/BV1xx411c7mD", "https://b23.tv/abc", "https://youtu.be/xyz",
    "https://m.youtube.com/watch?v=1", "https://notbilibili.com/x", "www.bilibili.com/video/1",
    "http://", "not_a_url", "https://example.com/bilibili.com/x", "ftp://youtube.com/a",
    "https://www.youtube.com/playlist?list=PL1", "https://www.youtube.com/watch?v=a&list=PL2&x=1",
    "https://www.youtube.com/watch?v=a&list=&list=PL3", "https://www.youtube.com/@someone",
    "https://space.bilibili.com/12345", "https://www.youtube.com/c/name", "HTTPS://WWW.YOUTUBE.COM/USER/X",
    "https://www.youtube.com/watch?v=a&LIST=Q",
]


def _py_strict(url):
    try:
        p = urlparse(url)
        if not p.scheme or not p.netloc:
            return False
        return any(d in p.netloc.lower() for d in fv.ALLOWED_DOMAINS)
    except Exception:  # noqa: BLE001
        return False


def test_predicates_match_python(spark):
    rows = one_col(spark, URLS, name="url").select(
        "url", U.allowed_domain("url").alias("loose"), U.supported_host("url").alias("strict"),
        U.is_playlist("url").alias("pl"), U.is_channel("url").alias("ch")).collect()
    for r in rows:
        low = r.url.lower()
        assert r.loose == any(d in low for d in fv.ALLOWED_DOMAINS), r.url
        assert r.strict == _py_strict(r.url), r.url
        assert r.pl == ("list=" in low or "/playlist?" in low), r.url
        assert r.ch == any(p in low for p in fv.CHANNEL_PATTERNS), r.url


def test_playlist_canonical_matches_python(spark):
    rows = one_col(spark, URLS, name="url").select("url", U.playlist_canonical("url").alias("c")).collect()
    for r in rows:
        qs = parse_qs(urlparse(r.url).query)
        lid = qs["list"][0] if qs.get("list") else None
        assert r.c == (f"{fv.PLAYLIST_URL_PREFIX}{lid}" if lid else r.url), r.url


def test_channel_listing_url(spark):
    rows = one_col(spark, ["https://www.youtube.com/channel/UC1", "https://www.youtube.com/@me",
                           "https://space.bilibili.com/1", "https://www.youtube.com/CHANNEL/x"],
                   name="url").select(U.channel_listing_url("url").alias("c")).collect()
    assert [r.c for r in rows] == ["https://www.youtube.com/channel/UC1/videos",
                                   "https://www.youtube.com/@me/videos",
                                   "https://space.bilibili.com/1", "https://www.youtube.com/CHANNEL/x"]


def _write(spark, lines):
    path = scratch_path(spark, "urltest")
    url_list.write_url_list(spark.createDataFrame([(x,) for x in lines], "line string"), path)
    return path


def test_url_list_rules(spark):
    path = _write(spark, ["  https://a.bilibili.com/1  ", "# comment", "   # indented comment", "",
                          "\t", "https://b23.tv/2", "https://b23.tv/2"])
    got = [r.url for r in url_list.read_url_list(spark, path).orderBy("url_ord").collect()]
    assert got == ["https://a.bilibili.com/1", "https://b23.tv/2", "https://b23.tv/2"]


def test_line_numbers_over_files_and_splits(spark):
    """Several files, each cut into many splits that tasks take in order of size: numbers follow the files' lines."""
    lines = [f"https://b23.tv/{i}" if i % 3 else f"# {i}" for i in range(4000)]
    path = scratch_path(spark, "urlparts")
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    url_list.write_url_list(rows.repartitionByRange(3, "i").sortWithinPartitions("i"), path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        read = url_list.read_url_list(spark, path)
        got = sorted((r.url_ord, r.url) for r in read.collect())
        assert read.rdd.getNumPartitions() > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [(i, x) for i, x in enumerate(lines) if not x.startswith("#")]


def test_url_list_empty_and_missing(spark):
    assert url_list.read_url_list(spark, _write(spark, ["# only", "  # comments"])).count() == 0
    assert url_list.read_url_list(spark, "/nonexistent/path/urls.txt").count() == 0


def _catalogue(spark):
    rows = [("C1", i, f"v{i}") for i in range(1, 16)] + [("C1", 16, None), ("PL1", 1, "p1"),
                                                           ("PL1", 2, None), ("PL1", 3, "p3"), ("C2", 1, "C2")]
    return spark.createDataFrame(rows, "container_id string, pos int, item_id string")


def test_route_order_limit_and_drops(spark):
    urls = spark.createDataFrame([
        (1, "https://www.youtube.com/channel/C1"), (2, "https://evil.example/x"),
        (3, "https://www.youtube.com/playlist?list=PL1"), (4, "https://b23.tv/item"),
        (5, "https://www.youtube.com/channel/C2"), (6, "https://www.youtube.com/playlist?list=NONE"),
        (7, "https://b23.tv/item")], "url_ord long, url string")
    out = expansion.route(urls, _catalogue(spark), limit=3).orderBy("url_ord", "sub_ord").collect()
    got = [(r.url_ord, r.url) for r in out]
    assert got == [(1, fv.ITEM_URL_PREFIX + "v1"), (1, fv.ITEM_URL_PREFIX + "v2"), (1, fv.ITEM_URL_PREFIX + "v3"),
                   (3, fv.ITEM_URL_PREFIX + "p1"), (3, fv.ITEM_URL_PREFIX + "p3"),
                   (4, "https://b23.tv/item"), (7, "https://b23.tv/item")]


def test_limit_zero_means_all(spark):
    urls = spark.createDataFrame([(1, "https://www.youtube.com/channel/C1")], "url_ord long, url string")
    assert expansion.channel_expand(urls, _catalogue(spark), 0).count() == 15


def test_limit_is_pushed_before_join(spark):
    urls = spark.createDataFrame([(1, "https://www.youtube.com/channel/C1")], "url_ord long, url string")
    path = scratch_path(spark, "cat")
    _catalogue(spark).write.parquet(path)
    cat = spark.read.parquet(path)
    plan = expansion.channel_expand(urls, cat, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(pos,3)" in plan


@pytest.mark.parametrize("hot_rows", [expansion.HOT_ROWS, 7])
def test_a_container_that_half_of_the_urls_share(spark, hot_rows):
    urls = spark.createDataFrame(
        [(i, "https://www.youtube.com/channel/C1" if i % 2 else f"https://www.youtube.com/channel/D{i % 5}") for i in range(200)]
        + [(200, "https://www.youtube.com/playlist?list=PL1")], "url_ord long, url string")
    listing = _catalogue(spark).unionByName(spark.createDataFrame(
        [(f"D{i}", 1, f"d{i}") for i in range(4)], "container_id string, pos int, item_id string"))
    out = [tuple(r) for r in expansion.route(urls, listing, limit=3, hot_rows=hot_rows).select("url_ord", "sub_ord", "url").collect()]
    want = [(i, n, fv.ITEM_URL_PREFIX + f"v{n}") for i in range(1, 200, 2) for n in (1, 2, 3)]
    want += [(i, 1, fv.ITEM_URL_PREFIX + f"d{i % 5}") for i in range(0, 200, 2) if i % 5 < 4]
    want += [(200, 1, fv.ITEM_URL_PREFIX + "p1"), (200, 3, fv.ITEM_URL_PREFIX + "p3")]
    assert sorted(out) == sorted(want)


def test_a_hot_container_is_spread_over_tasks(spark):
    """The rows of one key, half of all, leave the join from many partitions, each with few of them."""
    keyed = spark.range(40_000).selectExpr("id as url_ord", "concat('u', id) as url", "if(id % 2 = 0, 'hot', concat('k', id)) as _key")
    listing = spark.createDataFrame([("hot", 1, "a"), ("k1", 1, "b")], "container_id string, pos int, item_id string")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
                "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = expansion.join_listings(keyed, listing, 1, hot_rows=500)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 20_001 and max(sizes) < 6_000

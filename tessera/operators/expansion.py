"""URL expansion and routing: G2, G3, G4, T1, T6, J1.

Listing services are re-aimed as a *catalogue* table
``(container_id, pos, item_id)``: the entries of a channel or playlist in
listing order (``pos`` from 1).  Expanding a URL is an equi-join on the
container key:

* the first-``limit`` cut is applied to the catalogue before the join
  (``pos <= limit`` is pushed to the scan);
* the distinct keys of the URLs are semi-joined into the catalogue, so only
  the listings in demand are shuffled on;
* a key that more than ``HOT_ROWS`` URLs share is split: its URLs are dealt
  over as many salts as it has multiples of that, and its listing is repeated
  once a salt, so no task gets more than about ``HOT_ROWS`` URLs of a key.

Item URLs pass through without a shuffle; reading the URLs a second time for
them costs less than shuffling them along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import fixed_values as fv
from tessera.functions import urls as U

#: URLs of one container key that are joined in one task.
HOT_ROWS = 100_000


def _first_n(catalogue: DataFrame, limit: int) -> DataFrame:
    """Entries within the first ``limit`` positions (``limit <= 0``: all)."""
    return catalogue.where(F.col("pos") <= F.lit(limit)) if limit and limit > 0 else catalogue


def container_key(url: Column, kind: Column) -> Column:
    """Catalogue key of a container URL: the list id (the URL itself if it has none), or the
    channel's last path segment."""
    return (F.when(kind == F.lit("playlist"), F.coalesce(U.playlist_id(url), url))
            .when(kind == F.lit("channel"), U.last_path_segment(url)))


def join_listings(keyed: DataFrame, catalogue: DataFrame, limit: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """URLs (``_key``, ``url_ord``, ...) with the ``pos`` and ``item_id`` of their container's entries."""
    entries = _first_n(catalogue, limit).where(F.col("item_id").isNotNull())
    # partial counts: a hot key is one row a task
    keys = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("_key").alias("_own"), F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_salts"))
    listed = (entries.join(keys, F.col("container_id") == F.col("_own"))
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
              .select(F.col("container_id").alias("_own"), F.col("_salt").alias("_own_salt"), "pos", "item_id"))
    # at most a key for each hot_rows URLs
    hot = F.broadcast(keys.where("_salts > 1").withColumnsRenamed({"_own": "_hot", "_salts": "_parts"}))
    dealt = (keyed.join(hot, F.col("_key") == F.col("_hot"), "left")
             .withColumn("_salt", F.pmod(F.xxhash64("url_ord", "url"), F.coalesce(F.col("_parts"), F.lit(1))).cast("int")))
    return (dealt.join(listed, (F.col("_key") == F.col("_own")) & (F.col("_salt") == F.col("_own_salt")))
            .drop("_hot", "_parts", "_salt", "_own", "_own_salt"))


def _expand(urls: DataFrame, catalogue: DataFrame, limit: int, drop_self: bool,
            prefix: Column | str, hot_rows: int) -> DataFrame:
    j = join_listings(urls, catalogue, limit, hot_rows)
    if drop_self:
        j = j.where(F.col("item_id") != U.last_path_segment(F.col("url")))
    return j.select(
        "url_ord",
        F.col("pos").alias("sub_ord"),
        U.item_url(F.col("item_id"), prefix).alias("url"),
        F.col("url").alias("origin_url"),
    )


def channel_expand(urls: DataFrame, catalogue: DataFrame, limit: int = fv.DEFAULT_CHANNEL_LIMIT,
                   prefix: str = fv.ITEM_URL_PREFIX, hot_rows: int = HOT_ROWS) -> DataFrame:
    """First ``limit`` entries of each channel URL, minus broken and self ids."""
    keyed = urls.withColumn("_key", U.last_path_segment(F.col("url")))
    return _expand(keyed, catalogue, limit, True, prefix, hot_rows)


def playlist_expand(urls: DataFrame, catalogue: DataFrame, limit: int = 0,
                    prefix: str = fv.ITEM_URL_PREFIX, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Entries of the canonical playlist (F11), listed by URL where it has no list id;
    ``limit <= 0`` keeps all."""
    keyed = urls.withColumn("_key", container_key(F.col("url"), F.lit("playlist")))
    return _expand(keyed, catalogue, limit, False, prefix, hot_rows)


def route(urls: DataFrame, catalogue: DataFrame, limit: int = fv.DEFAULT_CHANNEL_LIMIT,
          prefix: str = fv.ITEM_URL_PREFIX, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Loose domain filter, then playlist / channel expansion or pass-through.

    Output ``(url_ord, sub_ord, url, kind)``: order is ``(url_ord, sub_ord)``;
    duplicates are kept; a container that expands to nothing disappears.
    """
    allowed = urls.where(U.allowed_domain(F.col("url"))).withColumn("kind", U.url_kind(F.col("url")))
    items = allowed.where(F.col("kind") == F.lit("item")).select(
        "url_ord", F.lit(0).alias("sub_ord"), "url", "kind")
    containers = allowed.where(F.col("kind") != F.lit("item"))
    keyed = containers.withColumn("_key", container_key(F.col("url"), F.col("kind")))
    j = join_listings(keyed, catalogue, limit, hot_rows)
    j = j.where((F.col("kind") == F.lit("playlist"))
                | (F.col("item_id") != U.last_path_segment(F.col("url"))))
    expanded = j.select("url_ord", F.col("pos").alias("sub_ord"),
                        U.item_url(F.col("item_id"), prefix).alias("url"), "kind")
    return items.unionByName(expanded)


def url_union(*lists: DataFrame) -> DataFrame:
    """Concatenation keeping duplicates; ``list_ord`` records the source order."""
    out = None
    for i, df in enumerate(lists):
        tagged = df.select(F.lit(i).alias("list_ord"), "url_ord", "url")
        out = tagged if out is None else out.unionByName(tagged)
    return out

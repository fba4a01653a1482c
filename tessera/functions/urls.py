"""URL predicates and rewrites as native Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import fixed_values as fv


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any_contains(c: Column, needles: Sequence[str]) -> Column:
    if not needles:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [c.contains(F.lit(n)) for n in needles])


def url_host(url: Column | str) -> Column:
    """Network location of a URL with a scheme; '' when there is none.

    Scheme = letter followed by letters, digits, '+', '-' or '.', then '://';
    the host runs to the first '/', '?' or '#'.  ``parse_url`` is not used
    because it returns NULL for several URLs the strict check must see.
    """
    return F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def has_scheme(url: Column | str) -> Column:
    return _col(url).rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")


def allowed_domain(url: Column | str, domains: Sequence[str] = fv.ALLOWED_DOMAINS) -> Column:
    """P1 (loose): a listed domain occurs anywhere in the lower-cased URL."""
    return F.coalesce(_any_contains(F.lower(_col(url)), domains), F.lit(False))


def supported_host(url: Column | str, platforms: Sequence[str] = fv.ALLOWED_DOMAINS) -> Column:
    """P2 (strict): scheme and host present and a platform occurs in the host."""
    host = F.lower(url_host(url))
    ok = has_scheme(url) & (host != F.lit("")) & _any_contains(host, platforms)
    return F.coalesce(ok, F.lit(False))


def is_playlist(url: Column | str, patterns: Sequence[str] = fv.PLAYLIST_PATTERNS) -> Column:
    """The lower-cased URL contains 'list=' or '/playlist?'."""
    return F.coalesce(_any_contains(F.lower(_col(url)), patterns), F.lit(False))


def is_channel(url: Column | str, patterns: Sequence[str] = fv.CHANNEL_PATTERNS) -> Column:
    """The lower-cased URL contains a channel marker."""
    return F.coalesce(_any_contains(F.lower(_col(url)), patterns), F.lit(False))


def url_kind(url: Column | str) -> Column:
    """Routing class: playlist wins over channel; the rest are items."""
    return (F.when(is_playlist(url), F.lit("playlist"))
            .when(is_channel(url), F.lit("channel"))
            .otherwise(F.lit("item")))


def query_string(url: Column | str) -> Column:
    """The part between the first '?' and the fragment."""
    return F.regexp_extract(_col(url), r"^[^?#]*\?([^#]*)", 1)


def playlist_id(url: Column | str) -> Column:
    """First non-blank, URL-decoded ``list`` query value; NULL when absent."""
    values = F.regexp_extract_all(query_string(url), F.lit(r"(?:^|&)list=([^&]+)"), F.lit(1))
    raw = F.try_element_at(values, F.lit(1))
    decoded = F.coalesce(F.try_url_decode(raw), raw)
    return F.nullif(decoded, F.lit(""))


def playlist_canonical(url: Column | str, prefix: str = fv.PLAYLIST_URL_PREFIX) -> Column:
    """rewrite to the canonical playlist URL when a list id is present."""
    pid = playlist_id(url)
    return F.when(pid.isNotNull(), F.concat(F.lit(prefix), pid)).otherwise(_col(url))


def channel_listing_url(url: Column | str,
                        markers: Sequence[str] = fv.CHANNEL_LISTING_MARKERS) -> Column:
    """append '/videos' when a (case-sensitive) channel marker is present."""
    u = _col(url)
    return F.when(_any_contains(u, markers), F.concat(u, F.lit("/videos"))).otherwise(u)


def last_path_segment(url: Column | str) -> Column:
    """Text after the last '/', as ``url.split('/')[-1]``."""
    return F.substring_index(_col(url), "/", -1)


def item_url(item_id: Column | str, prefix: Column | str = fv.ITEM_URL_PREFIX) -> Column:
    """item URL from an id."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(p, _col(item_id))

"""URL parts as columns, taken apart the way a permissive URL splitter does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts a video may live on, and the host lyrics pages come from.
BOOK_VIDEO_HOSTS = ("youtube.com", "www.youtube.com")
POEM_VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com")
SHORT_VIDEO_HOST = "youtu.be"
LYRICS_HOST = "genius.com"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Lower-case host without credentials and port."""
    return F.lower(F.regexp_extract(authority(url), r"^(?:.*@)?([^:@]*)(?::[^@]*)?$", 1))


def has_credentials(url: Column) -> Column:
    return authority(url).contains("@")


def port(url: Column) -> Column:
    """Port text; empty when there is none."""
    return F.regexp_extract(authority(url), r":([^:@]*)$", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#]*)?([^?#]*)", 1)


def query_value(url: Column, name: str) -> Column:
    """First non-blank value of a query field, decoded; NULL when there is none."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    raw = F.nullif(F.regexp_extract(query, rf"(?:^|&){name}=([^&]+)", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(raw), raw)


def _first_segment(path_: Column, prefix: str) -> Column:
    return F.nullif(F.regexp_extract(path_, rf"^{prefix}([^/]*)", 1), F.lit(""))


def book_video_id(url: Column) -> Column:
    """Id in a short link, in ``/watch?v=`` or in ``/shorts/``."""
    site, where = host(url), path(url)
    return (
        F.when(site == SHORT_VIDEO_HOST, _first_segment(where, "/?"))
        .when(site.isin(*BOOK_VIDEO_HOSTS) & (where == "/watch"), query_value(url, "v"))
        .when(site.isin(*BOOK_VIDEO_HOSTS), _first_segment(where, "/shorts/"))
    )


def poem_video_id(url: Column) -> Column:
    """Id in a short link or in a ``v`` field below any path; HTTPS only."""
    site = host(url)
    found = F.when(site == SHORT_VIDEO_HOST, _first_segment(path(url), "/*")).when(
        site.isin(*POEM_VIDEO_HOSTS), query_value(url, "v")
    )
    return F.when(scheme(url) == "https", found)


def is_http_url(url: Column) -> Column:
    return scheme(url).isin("http", "https") & (authority(url) != "")


def is_canonical_lyrics_url(url: Column, lyrics_host: str = LYRICS_HOST) -> Column:
    """HTTPS, the lyrics host or a subdomain, no credentials, no port but 443."""
    site = host(url)
    return (
        (scheme(url) == "https")
        & ((site == lyrics_host) | site.endswith("." + lyrics_host))
        & ~has_credentials(url)
        & port(url).isin("", "443")
    )

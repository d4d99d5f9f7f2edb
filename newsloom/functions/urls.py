"""URL parts and canonical form, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import strip

# Query parameters that never identify a page.
TRACKING_PARAMETERS = (
    "fbclid",
    "gclid",
    "mc_cid",
    "mc_eid",
    "utm_campaign",
    "utm_content",
    "utm_medium",
    "utm_source",
    "utm_term",
)

# The generic URI split of RFC 3986, appendix B.
URI = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
AUTHORITY = r"^(?:.*@)?(?:\[([^\]]*)\]|([^:]*))(?::(\d*))?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URI, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, URI, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, URI, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, URI, 4)


def hostname(url: Column) -> Column:
    """Lower-case host without user, port and brackets; '' when there is none."""
    place = authority(url)
    return F.lower(
        F.concat(F.regexp_extract(place, AUTHORITY, 1), F.regexp_extract(place, AUTHORITY, 2))
    )


def port(url: Column) -> Column:
    return F.regexp_extract(authority(url), AUTHORITY, 3).try_cast("int")


def _decode(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))


def _encode(part: Column) -> Column:
    out = F.replace(F.url_encode(part), F.lit("%7E"), F.lit("~"))
    return F.replace(out, F.lit("*"), F.lit("%2A"))


def canonical_query(raw: Column) -> Column:
    """Decoded pairs without tracking parameters, sorted and encoded again."""
    pieces = F.filter(F.split(raw, "&"), lambda p: p != "")
    pairs = F.transform(
        pieces,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            _decode(F.regexp_extract(p, "^[^=]*=?(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda kv: ~F.lower(kv["k"]).isin(*TRACKING_PARAMETERS))
    return F.array_join(
        F.transform(
            F.sort_array(kept), lambda kv: F.concat(_encode(kv["k"]), F.lit("="), _encode(kv["v"]))
        ),
        "&",
    )


def canonicalize(url: Column) -> Column:
    """One spelling per page: see ``operators.ingest.canonicalize_url``."""
    url = strip(url)
    s, number, where = scheme(url), port(url), path(url)
    default_port = ((s == "http") & (number == 80)) | ((s == "https") & (number == 443))
    host = F.concat(
        hostname(url),
        F.when(number.isNotNull() & (number != 0) & ~default_port, F.concat(F.lit(":"), number))
        .otherwise(""),
    )
    q = canonical_query(query(url))
    return F.concat(
        F.when(s != "", F.concat(s, F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        F.when(where == "", "/").otherwise(where),
        F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""),
    )


def site_domain(url: Column) -> Column:
    """Host without one leading ``www.``."""
    return F.regexp_replace(hostname(url), r"^www\.", "")

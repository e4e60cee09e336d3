"""URL columns, split by the generic URI grammar.

``parse_url`` is not used: it rejects addresses with spaces and keeps the
case of hosts.  Null addresses count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn import fixed

#: Groups: 2 scheme, 4 authority, 5 path, 7 query, 9 fragment.
GRAMMAR = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
JUNK_EXTENSION = r"(?i)\.(" + "|".join(fixed.JUNK_EXTENSIONS) + r")$"
JUNK_DOMAIN = "(?i)(" + "|".join(fixed.JUNK_DOMAINS) + ")"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), GRAMMAR, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 2))


def authority(url: Column) -> Column:
    return F.lower(_part(url, 4))


def path(url: Column) -> Column:
    return _part(url, 5)


def query(url: Column) -> Column:
    return _part(url, 7)


def normalized(url: Column) -> Column:
    """Scheme and host in lower case, without fragment and trailing slashes."""
    u = F.trim(url)
    return F.concat(
        F.when(scheme(u) != "", F.concat(scheme(u), F.lit(":"))).otherwise(""),
        F.when(authority(u) != "", F.concat(F.lit("//"), authority(u))).otherwise(""),
        F.regexp_replace(path(u), "/+$", ""),
        F.when(query(u) != "", F.concat(F.lit("?"), query(u))).otherwise(""),
    )


def useful(url: Column) -> Column:
    """Whether the address is of the web, of no file and of no platform that is never read.

    Domains are looked for anywhere in the address.
    """
    web = url.startswith("http://") | url.startswith("https://")
    return F.coalesce(web & ~url.rlike(JUNK_EXTENSION) & ~url.rlike(JUNK_DOMAIN), F.lit(False))


def domain(url: Column) -> Column:
    """The host with port, without a leading ``www.``."""
    return F.regexp_replace(authority(url), r"^www\.", "")


def same_domain(a: Column, b: Column) -> Column:
    return (domain(a) != "") & (domain(a) == domain(b))


def homepage(url: Column) -> Column:
    """The root of the address's host with a slash; the address itself if it has no host."""
    kind = F.when(scheme(url) == "", "https").otherwise(scheme(url))
    return F.when(authority(url) == "", url).otherwise(F.concat(kind, F.lit("://"), _part(url, 4), F.lit("/")))


def bare_homepage(url: Column) -> Column:
    """The same without the slash, in lower case."""
    return F.concat(scheme(url), F.lit("://"), authority(url))


def segments(some_path: Column) -> Column:
    """The parts of a path in lower case."""
    return F.filter(F.split(F.lower(some_path), "/"), lambda x: x != "")


def cased_segments(some_path: Column) -> Column:
    return F.filter(F.split(some_path, "/"), lambda x: x != "")


def repository_root(url: Column) -> Column:
    """Host and first two parts of the path, or the homepage."""
    parts = cased_segments(path(url))
    kind = F.when(scheme(url) == "", "https").otherwise(scheme(url))
    root = F.concat(kind, F.lit("://"), _part(url, 4), F.lit("/"), F.element_at(parts, 1), F.lit("/"), F.element_at(parts, 2))
    return F.when(F.size(parts) >= 2, root).otherwise(homepage(url))


def owner_and_name(url: Column) -> Column:
    """(owner, name) of a repository's address, or (empty, first label of the host)."""
    parts = cased_segments(path(url))
    alone = F.struct(F.lit("").alias("owner"), F.substring_index(domain(url), ".", 1).alias("name"))
    return F.when(F.size(parts) >= 2, F.struct(F.element_at(parts, 1).alias("owner"), F.element_at(parts, 2).alias("name"))).otherwise(alone)


def deduplicated(urls: Column) -> Column:
    """Of an array, the useful addresses whose normal form was not there before, as they are."""
    pairs = F.filter(F.transform(urls, lambda u: F.struct(normalized(u).alias("n"), u.alias("u"))), lambda x: useful(x["n"]))
    kept = F.filter(pairs, lambda x, i: F.array_position(F.transform(pairs, lambda y: y["n"]), x["n"]) == i + 1)
    return F.transform(kept, lambda x: x["u"])

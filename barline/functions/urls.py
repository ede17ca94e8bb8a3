"""Profile domains and logo candidates."""

from pyspark.sql import Column, functions as F

from .text import http_or_null, text_or_empty

HOST = r"^https?://(?:[^/?#@]*@)?([^/?#:]*)"
SITE_ROOT = r"^(https?://[^/?#]*)"


def hostname(url: Column) -> Column:
    return F.lower(F.regexp_extract(text_or_empty(url), HOST, 1))


def profile_domain(domain: Column, website: Column) -> Column:
    own = F.lower(F.trim(text_or_empty(domain)))
    found = F.when(own != "", own).otherwise(hostname(http_or_null(website)))
    bare = F.regexp_replace(found, r"^www\.", "")
    return F.regexp_replace(bare, "^/+|/+$", "")


def percent_encoded(c: Column) -> Column:
    """Percent-encoding with %20 for blanks and nothing but letters, digits and _.-~ kept."""
    plain = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(plain, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def logo_service_url(domain: Column) -> Column:
    # fixed values: public logo and icon services
    return F.when(
        domain != "",
        F.concat(F.lit("https://img.logo.dev/"), percent_encoded(domain), F.lit("?size=128&format=png&fallback=404")),
    )


def logo_candidates(logo_url: Column, domain: Column, website: Column) -> Column:
    """Distinct candidate URLs in order of preference."""
    site = http_or_null(website)
    own_domain = profile_domain(domain, website)
    host = F.nullif(hostname(site), F.lit(""))
    return F.array_distinct(
        F.array_compact(
            F.array(
                http_or_null(logo_url),
                logo_service_url(own_domain),
                F.concat(F.nullif(F.regexp_extract(site, SITE_ROOT, 1), F.lit("")), F.lit("/favicon.ico")),
                F.concat(F.lit("https://icons.duckduckgo.com/ip3/"), host, F.lit(".ico")),
                F.concat(
                    F.lit("https://www.google.com/s2/favicons?domain_url="),
                    percent_encoded(site),
                    F.lit("&sz=128"),
                ),
            )
        )
    )


_URL = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _without_dots(path: Column) -> Column:
    """A path whose `.` and `..` steps are taken; steps above the root are dropped."""
    steps = F.split(path, "/")
    taken = F.aggregate(
        steps, F.array(F.lit("")),
        lambda done, step: F.when(step == ".", done)
        .when(step == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done))
        .otherwise(F.concat(done, F.array(step))),
    )
    folder = F.element_at(steps, -1).isin(".", "..")
    joined = F.array_join(F.slice(taken, F.lit(2), F.size(taken)), "/")
    return F.when(folder & (joined != "") & ~F.endswith(joined, F.lit("/")), F.concat(joined, F.lit("/"))).otherwise(joined)


def joined_url(base: Column, link: Column) -> Column:
    """`link` as seen from the page `base`, absolute where `base` is; an empty link is the page itself."""
    def part(url, k):
        return F.regexp_extract(url, _URL, k)

    scheme = F.lower(part(base, 1))
    start = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(part(base, 2) != "", F.concat(F.lit("//"), part(base, 2))).otherwise(""))
    own_path, base_path = part(link, 3), part(base, 3)
    folder = F.regexp_extract(base_path, "(?s)^(.*/)", 1)
    rooted = F.when(F.startswith(own_path, F.lit("/")), own_path).otherwise(
        F.concat(F.when((folder == "") & (part(base, 2) != ""), "/").otherwise(folder), own_path)
    )
    path = F.when(F.contains(rooted, F.lit("/.")), F.concat(F.lit("/"), _without_dots(F.substring(rooted, 2, 1 << 30)))).otherwise(rooted)
    tail = F.concat(part(link, 4), part(link, 5))
    return (
        F.when(link == "", base)
        .when(part(link, 1) != "", link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), link))
        .when(own_path != "", F.concat(start, path, tail))
        .when(part(link, 4) != "", F.concat(start, base_path, tail))
        .otherwise(F.concat(start, base_path, part(base, 4), part(link, 5)))
    )

"""URL expressions. Null in, null out; what is no http(s) URL normalises to the empty string."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^#]*)"

# File endings, path parts and media types that mark a download.
FILE_ENDINGS = (".pdf", ".doc", ".docx", ".zip", ".rar", ".7z", ".djvu", ".tex", ".ps", ".xls", ".xlsx", ".ppt", ".pptx", ".torrent")
DOWNLOAD_PATHS = ("/pdf/", "/media-download/", "/file/download/", "/download/")
FILE_TYPES = (
    "application/pdf", "application/zip", "application/x-zip-compressed", "application/msword",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/x-7z-compressed",
    "application/x-rar-compressed", "application/x-bittorrent",
)


def normalize(url: Column) -> Column:
    """Trimmed, without fragment, scheme and host in lower case; path and query are left as they are."""
    u = F.trim(url)
    scheme, host = F.lower(F.regexp_extract(u, _PARTS, 1)), F.lower(F.regexp_extract(u, _PARTS, 2))
    good = scheme.isin("http", "https") & (host != "")
    return F.when(url.isNull(), None).when(good, F.concat(scheme, F.lit("://"), host, F.regexp_extract(u, _PARTS, 3))).otherwise("")


def host(url: Column) -> Column:
    """Host in lower case, without user and port."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, _PARTS, 2)), r"^.*@", ""), r":\d*$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def resource_id(url: Column) -> Column:
    """First 24 hex digits of SHA-256 of the normalised URL; empty if there is none."""
    clean = normalize(url)
    return F.when(clean == "", "").otherwise(F.substring(F.sha2(clean, 256), 1, 24))


def document_id(url: Column) -> Column:
    """First 20 hex digits of SHA-1 of the URL without its fragment."""
    return F.substring(F.sha1(F.trim(F.regexp_replace(url, "#.*$", ""))), 1, 20)


def without_dots(path: Column) -> Column:
    """A path without its `.` and `..` segments; it begins with a slash."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1).isin(".", "..")
    fold = lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), fold)
    joined = F.array_join(F.when(last, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    rooted = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), rooted).otherwise(path)


def resolve(base: Column, href: Column) -> Column:
    """The absolute URL of a link on the page `base`: absolute, host-relative, rooted, query-only and plain relative links."""
    scheme, netloc = F.regexp_extract(base, _PARTS, 1), F.regexp_extract(base, _PARTS, 2)
    root = F.concat(scheme, F.lit("://"), netloc)
    folder = F.regexp_replace(F.when(path(base) == "", "/").otherwise(path(base)), r"[^/]*$", "")
    own, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, without_dots(own), rest))
        .when(href.startswith("?"), F.concat(root, path(base), href))
        .when(href.startswith("#") | (href == ""), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(root, without_dots(F.regexp_replace(F.concat(folder, own), "/{2,}", "/")), rest))
    )


def likely_file(url: Column, mime: Column | None = None) -> Column:
    """Whether the path or the media type suggests a document to download."""
    p = F.lower(path(url))
    found = F.lit(False)
    for x in FILE_ENDINGS:
        found = found | p.endswith(x)
    for x in DOWNLOAD_PATHS:
        found = found | p.contains(x)
    if mime is not None:
        found = found | F.coalesce(F.trim(F.lower(F.split(mime, ";")[0])).isin(*FILE_TYPES), F.lit(False))
    return found


#: Character references by name, as HTML 5 has them.
NAMED = json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")})


def unescape(text: Column) -> Column:
    """Character references with a semicolon as characters: by name, decimal and hexadecimal. Bare ampersands and unknown names stay."""
    names = F.from_json(F.lit(NAMED), "map<string,string>")  # folded to a constant

    def character(x: Column) -> Column:
        code = F.when(x.rlike("^&#[xX]"), F.conv(F.substring(x, 4, 8), 16, 10)).otherwise(F.regexp_extract(x, r"^&#(\d{1,7});$", 1)).try_cast("int")
        known = F.when((code > 0) & (code < 0x110000), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.when(x.startswith("&#"), F.coalesce(known, x)).when(x.rlike("^&.+;$"), F.coalesce(F.try_element_at(names, F.regexp_replace(x, "[&;]", "")), x)).otherwise(x)

    pieces = F.regexp_extract_all(text, F.lit(r"(&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);|[^&]+|&)"), F.lit(1))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, character), "")).otherwise(text)

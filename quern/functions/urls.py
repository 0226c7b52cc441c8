"""URL and image columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(?:#.*)?$"

# Extensions that are no pages, image types, host prefixes of other languages' editions, words of decorative images.
BLOCKED = tuple(
    "jpg jpeg png gif bmp webp svg ico tif tiff css js json xml rss atom woff woff2 ttf eot pdf doc docx xls xlsx ppt pptx odt csv "
    "zip rar 7z tar gz bz2 exe msi apk dmg iso mp3 mp4 avi mkv mov wmv flv wav m4a webm".split()
)
IMAGES = ("jpg", "jpeg", "png", "gif", "webp", "avif", "bmp", "svg")
FOREIGN = ("cn.", "zh.", "ja.", "jp.", "ko.", "kr.", "ru.", "fr.", "es.", "de.", "pt.", "ar.", "th.", "lo.", "km.")
DECORATIVE = "thumb|icon|logo|avatar|sprite|placeholder|blank|banner|badge|button|favicon|watermark|1x1|pixel|spacer"


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, n)


def host(url: Column) -> Column:
    """Lower-case host; empty if there is none."""
    return F.lower(part(url, 2))


def site(url: Column) -> Column:
    """host without a leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def shown_host(url: Column) -> Column:
    """As corpus statistics show it: www-stripped, case kept, a label where there is none."""
    h = F.regexp_replace(part(url, 2), r"^www\.", "")
    return F.when(h == "", F.lit("(không rõ)")).otherwise(h)


def canonical(url: Column) -> Column:
    """Fragment, default port and trailing slash go, scheme and host in lower case, the query stays. What can't be parsed only loses its fragment."""
    scheme, port, path = F.lower(part(url, 1)), part(url, 3), part(url, 4)
    default = (scheme == "http") & (port == "80") | (scheme == "https") & (port == "443") | (port == "")
    known = F.concat(scheme, F.lit("://"), host(url), F.when(default, "").otherwise(F.concat(F.lit(":"), port)), F.regexp_replace(path, r"/+$", ""), part(url, 5))
    return F.when(url.isNull(), None).when(url.rlike(URL) & (host(url) != ""), known).otherwise(F.regexp_replace(url, "#.*$", ""))


def extension(url: Column) -> Column:
    """Of the last segment of the path, lower case."""
    return F.lower(F.regexp_extract(part(url, 4), r"\.([A-Za-z0-9]+)$", 1))


def reject_reason(url: Column, depth: Column, max_depth: int, domains: tuple[str, ...] = (), excluded: tuple[str, ...] = FOREIGN) -> Column:
    """The first rule that a link fails, null if it passes."""
    h = host(url)
    out = F.when(depth > max_depth, "depth").when(url.isNull() | ~F.lower(part(url, 1)).isin("http", "https") | (h == ""), "scheme")
    if domains:
        inside = F.lit(False)
        for d in domains:
            inside = inside | h.endswith(d)
        out = out.when(~inside, "domain")
    foreign = F.lit(False)
    for prefix in excluded:
        foreign = foreign | h.startswith(prefix)
    return out.when(foreign, "language").when(extension(url).isin(*BLOCKED), "extension")


# Names of hosts that are never fetched.
INNER = ("localhost", "metadata", "metadata.google.internal", "instance-data", "169.254.169.254")


def blocked_host(host: Column) -> Column:
    """No host, a name of the inner network, or an address literal of a loopback, local, shared, any or multicast range."""
    h = F.lower(F.trim(F.coalesce(host, F.lit(""))))
    bare = F.regexp_replace(F.regexp_replace(h, r"^\[|\]$", ""), r"^::ffff:(?=[0-9]+\.)", "")
    octets = [F.regexp_extract(bare, r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$", k).try_cast("int") for k in range(1, 5)]
    a, b = octets[:2]
    is_v4 = F.coalesce(F.greatest(*octets) <= 255, F.lit(False)) & octets[0].isNotNull()
    anywhere = (a == 0) & (b == 0) & (octets[2] == 0) & (octets[3] == 0)
    v4 = a.isin(10, 127) | anywhere | a.between(224, 239) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127))
    v6 = bare.contains(":") & (bare.isin("::", "::1", "0:0:0:0:0:0:0:0", "0:0:0:0:0:0:0:1") | bare.rlike("^(fe[89a-f]|f[cdf])[0-9a-f]{0,2}:"))
    return (h == "") | h.isin(*INNER) | h.endswith(".localhost") | F.coalesce(is_v4 & v4, F.lit(False)) | v6


def on_site(url: Column, wanted: str) -> Column:
    """The host is the wanted one or under it."""
    return (site(url) == wanted) | site(url).endswith("." + wanted)


def resolved(base: Column, link: Column) -> Column:
    """An absolute http(s) link, canonical; null for others."""
    root = F.concat(F.lower(part(base, 1)), F.lit("://"), part(base, 2), F.when(part(base, 3) != "", F.concat(F.lit(":"), part(base, 3))).otherwise(""))
    folder = F.regexp_replace(part(base, 4), r"[^/]*$", "")
    full = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.lower(part(base, 1)), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("#") | (link == ""), F.concat(root, part(base, 4)))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )
    return F.when(F.lower(full).rlike("^https?://"), canonical(full))


def declared_width(url: Column, attribute: Column) -> Column:
    """From the attribute's digits, a width parameter (w, width, rw, mw) or a size in the path (/640x480/, _640x480.jpg); -1 if unknown."""
    texts = [
        F.regexp_extract(F.coalesce(attribute, F.lit("")), r"^\s*([0-9]{1,9})", 1),
        F.regexp_extract(url, r"(?i)[?&](?:w|width|rw|mw)=([0-9]{2,4})", 1),
        F.regexp_extract(url, r"[_/-]([0-9]{3,4})x[0-9]{3,4}[_./-]", 1),
    ]
    return F.coalesce(*(F.when(t != "", t.cast("int")) for t in texts), F.lit(-1))


def image_tier(url: Column, width: Column) -> Column:
    """0 decorative, 3 at least 200 wide, 2 of unknown width, 1 small."""
    decorative = F.lower(url).rlike(rf"\.(?:svg|gif|ico|bmp)(?:\?|#|$)|{DECORATIVE}")
    return F.when(decorative, 0).when(width <= 0, 2).when(width >= 200, 3).otherwise(1)

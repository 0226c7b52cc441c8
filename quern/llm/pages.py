"""HTML extraction by nearest-URL page differencing.

A page becomes lines: the texts of its blocks, in order, but for markup, scripts,
styles and forms. Two steps say which lines aren't the article:

1. Differencing. The pages of a host that have the same lines are one page. A
   page's sign is the longest line outside article elements that other pages of
   the host have too. Pages of one host and sign, which share a piece of template, are put
   in order of their URL's path, and each is compared with the up to `reach` pages
   before and after it: lines are aligned by longest common subsequence, and lines
   that the nearest of them shares belong to the template and go.
2. What differencing can't show, as no other page of the host has that template, goes
   by the elements, classes and roles that mark menus, headers, footers, sidebars,
   notices, adverts and comments. n_deleted counts the lines of step 1 only.

Of a page with an article element the lines inside it are kept, of others all that
are left. Copies must not delete each other. A neighbour that shares more than
`copy_share` of the page's article lines (of a page without an article element: all
its lines) is a mirror and is passed over, and a line inside the page's article
element goes only if it is shared with all neighbours, two at least.

Lines travel as 32-bit hashes; only pages that lose a line move, as compressed text, to
meet the verdict on them. The order is a range-partitioned sort, so a host of any size
spreads over all tasks.

A null or empty html gives no text; pages of any length are read whole. A null or
unparsable url stands under the empty host. Equal urls are ordered by id. Pages that
share an id are kept apart; rows that are equal in id, url and html lose the same
lines. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as references
import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import kernel

#: Elements whose text is no line: scripts, styles, forms, embedded things.
DROPPED = frozenset("head script style noscript template svg math form button select textarea iframe object canvas dialog label fieldset datalist map audio video".split())
#: Elements that stand around an article.
FRAMES = frozenset("nav aside menu footer".split())
RAW = frozenset("script style noscript template svg iframe textarea title".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are closed by name; all others end where their block does.
HELD = frozenset("article main section div header footer nav aside form ul ol dl table figure details blockquote dialog menu fieldset button select label".split()) | RAW
ARTICLES = frozenset("article main".split())
MARKS = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|promo\w*|banners?|nav\w*|menus?|sidebars?|comments?|commentlist|replies|respond|disqus|footer|masthead|topbar|cookies?\w*|consent|gdpr|notices?|alerts?|popup|modal"
    r"|newsletter|subscri\w*|signup|login|shar(?:e|ing)|social|related|recommend\w*|breadcrumbs?|paginat\w*|pager|toolbar|widgets?|skip-link)(?=$|[-_\s])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][-\w:]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"([-\w:]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b")


def unwanted(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element's text is no line, and whether it is no article's; inside: the element stands in an article."""
    drop, frame = tag in DROPPED, tag in FRAMES or tag == "header" and not inside
    if "=" in attributes or "hidden" in attributes:
        for name, a, b, c, hidden in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            drop = drop or bool(hidden) or name == "aria-hidden" and value.lower() == "true"
            frame = frame or name == "role" and value.lower() in ROLES
            if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
                frame = frame or bool(MARKS.search(value))
    return drop, frame


def lines_of(page: str | None) -> list[tuple[str, bool]]:
    """The lines that no element marks as foreign, each with whether it stands in an article element."""
    return [(t, kind == ARTICLE) for t, kind in all_lines(page) if kind != FRAME]


#: Where a line stands.
PLAIN, ARTICLE, FRAME = 0, 1, 2


def all_lines(page: str | None) -> list[tuple[str, int]]:
    """The page's lines, each with where it stands."""
    out: list[tuple[str, int]] = []
    if not page:
        return out
    parts: list[str] = []
    held: list[tuple[str, tuple]] = []  # open elements, and the state inside
    state = skip, frame, article = False, False, False
    raw, at, lower = "", 0, None

    def flush():
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            if text:
                out.append((text, FRAME if frame else ARTICLE if article else PLAIN))
            parts.clear()

    while at < len(page):
        if raw:  # what these hold is no markup
            lower = lower or page.lower()
            end = lower.find(f"</{raw}", at)
            at = len(page) if end < 0 else end
            raw = ""
            continue
        m = TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not skip:
            parts.append(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag == "br":
            parts.append(" ")
        if tag in BLOCKS or tag in DROPPED or tag in FRAMES:
            flush()
        if m[1]:
            if tag in HELD or held and held[-1][0] == tag:
                if any(h[0] == tag for h in held):
                    while held.pop()[0] != tag:
                        pass
        elif tag in HELD:
            if not (m[3].rstrip().endswith("/") and tag in RAW):
                drop, outside = unwanted(tag, m[3], article)
                held.append((tag, (skip or drop, frame or outside, article or tag in ARTICLES)))
                raw = tag if tag in RAW else ""
        else:
            if tag in ("p", "li", "td", "tr", "dd", "dt") and held and held[-1][0] == tag:
                held.pop()  # an unclosed one ends where the next begins
                state = held[-1][1] if held else (False, False, False)
                skip, frame, article = state
            if tag in BLOCKS and not skip:
                drop, outside = unwanted(tag, m[3], article)
                if drop or outside and not frame:
                    held.append((tag, (drop, frame or outside, article)))
        state = held[-1][1] if held else (False, False, False)
        skip, frame, article = state
    flush()
    return out


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence of a and b: equal ends first, then Hunt and Szymanski's chains."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    where: dict[int, list[int]] = {}
    for j in range(len(b) - high - 1, low - 1, -1):
        where.setdefault(b[j], []).append(j)
    tails: list[int] = []
    chains: list[tuple] = []
    from bisect import bisect_left

    for i in range(low, len(a) - high):
        for j in where.get(a[i], ()):
            k = bisect_left(tails, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                chains.append(link)
            else:
                tails[k], chains[k] = j, link
    middle, link = [], chains[-1] if chains else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(low), *middle[::-1], *range(len(a) - high, len(a))]


def nearness(a: str, b: str) -> int:
    """Length of the common start of two paths."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def verdict(path: str, sign: int, own: list[int], kinds: list[int], near: list[tuple[str, int, list[int]]], copy_share: float) -> list[int]:
    """Places of the lines that go. near: (path, sign, lines) of the pages around."""
    if not own:
        return []
    some = ARTICLE in kinds
    body = [k for k, p in enumerate(kinds) if p == ARTICLE] or [*range(len(own))]
    most = copy_share * len(body) if some else len(body) - 1
    shared = []
    for _, _, other in sorted(near, key=lambda n: (n[1] != sign, -nearness(path, n[0]))):
        same = set(common(own, other))
        if len([k for k in body if k in same]) <= most:
            shared.append(same)
    if not shared:
        return []
    gone = {k for k in shared[0] if not (some and kinds[k] == ARTICLE)}
    if len(shared) >= 2:
        gone |= set.intersection(*shared)
    return sorted(gone)


def plain(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(_key, _url, _html, _t, _m): _t is 128 bits that stand for a row, equal rows are one; _m is half of them."""
    rows = pages.select(F.col(f"`{id_col}`").alias("_key"), F.col(f"`{url_col}`").cast("string").alias("_url"), F.col(f"`{html_col}`").cast("string").alias("_html"))
    digest = F.md5(F.concat_ws("\0", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("_key", "_url", "_html"))).cast("binary"))
    return rows.withColumn("_t", F.unhex(digest)).withColumn("_m", lead("_t"))


def lead(name: str):
    return F.conv(F.hex(F.substring(name, 1, 8)), 16, -10).cast("long")


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def outlines(rows: DataFrame) -> DataFrame:
    """(_t, _key, _host, _path, _kinds, _hashes, _outer, _sizes): of each page its place in the order and its lines, without their text.

    _outer: of the lines outside article elements (without one, of all) a hash of host and text, and their lengths.
    """
    address = F.regexp_replace(F.coalesce("_url", F.lit("")), r"[?#].*$", "")
    rows = rows.withColumn("_host", F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1)))
    rows = rows.withColumn("_path", F.regexp_replace(F.regexp_replace(address, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), r"(?:\.html?|/)$", ""))

    def work(frames):
        for frame in frames:
            found = [all_lines(h) for h in frame["_html"]]
            outer = []
            for host, f in zip(frame["_host"], found, strict=True):
                some = any(kind == ARTICLE for _, kind in f)
                outer.append({digest(f"{host}\0{t}"): min(len(t), 32767) for t, kind in f if not (some and kind == ARTICLE)})
            yield pd.DataFrame({
                "_t": frame["_t"],
                "_key": frame["_key"],
                "_host": frame["_host"],
                "_path": frame["_path"],
                "_kinds": [[kind for _, kind in f] for f in found],
                "_hashes": [[digest(t) >> 32 for t, _ in f] for f in found],
                "_outer": [[*o] for o in outer],
                "_sizes": [[*o.values()] for o in outer],
            })

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInPandas(work, f"_t binary, _key {kind}, _host string, _path string, _kinds array<tinyint>, _hashes array<int>, _outer array<long>, _sizes array<smallint>")


def distinct_pages(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row of the pages of a host that have the same lines, the first by path; and (_t, _host, _same) of all.

    Pages without lines have nothing to share and stand beside none.
    """
    lines = F.concat(F.array_join(F.col("_hashes").cast("array<string>"), ","), F.lit(";"), F.array_join(F.col("_kinds").cast("array<string>"), ","))
    rows = rows.where(F.size("_hashes") > 0).withColumn("_same", F.unhex(F.md5(lines.cast("binary"))))
    first = F.min(F.struct("_path", "_key", "_t", "_kinds", "_hashes", "_outer", "_sizes")).alias("_first")
    return rows.groupBy("_host", "_same").agg(first).select("_host", "_same", "_first.*"), rows.select("_t", "_host", "_same").distinct()


def with_sign(rows: DataFrame, bits: int) -> DataFrame:
    """rows with _sign in place of _outer and _sizes: the longest line that four pages of the host have, else two, else 0."""
    pages = rows.select(F.explode("_outer").alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pages = kernel.written(pages, "lines")
    two, four = kernel.bitmap(pages, "line", bits), kernel.bitmap(pages.where("n > 3"), "line", bits)
    kernel.discard(pages)

    @F.arrow_udf("long")
    def sign(outer: pa.Array, sizes: pa.Array) -> pa.Array:
        out = []
        for own, size in zip(outer.to_pylist(), sizes.to_pylist(), strict=True):
            lines = np.array(own, np.int64)
            rank = np.zeros(0) if not own else np.where(kernel.in_bitmap(four, lines, bits), 2.0, np.where(kernel.in_bitmap(two, lines, bits), 1.0, 0.0)) * 1e5
            rank = np.where(rank > 0, rank + np.array(size, float), 0)
            best = rank.max(initial=0)
            out.append(int(lines[rank == best].min()) if best > 0 else 0)
        return pa.array(out, pa.int64())

    return rows.withColumn("_sign", sign("_outer", "_sizes")).drop("_outer", "_sizes")


def verdicts(rows: DataFrame, reach: int, copy_share: float, bits: int) -> DataFrame:
    """(_t, _gone): places of the lines that go, of pages that have any. Copies on a host share the verdict of one."""
    kernel.bounded(rows.sparkSession)
    ones, members = distinct_pages(rows)
    ones = kernel.written(ones, "pages")
    ranged = kernel.in_order(with_sign(ones, bits), ["_host", "_sign", "_path", "_key", "_t"], "ordered").drop("_key", "_t")
    steps = [k for k in range(-reach, reach + 1) if k]
    sent = ranged.withColumn("_step", F.explode(F.array(*(F.lit(k) for k in steps))))
    near = F.struct(F.col("_step").alias("step"), F.col("_path").alias("path"), F.col("_sign").alias("sign"), F.col("_hashes").alias("hashes"))
    sent = sent.select((F.col("_nth") + F.col("_step")).alias("_nth"), F.col("_host").alias("_from"), near.alias("_near"))
    met = ranged.join(sent, "_nth").where(F.col("_host") == F.col("_from"))
    met = met.groupBy("_nth", "_host", "_same", "_path", "_sign", "_kinds", "_hashes").agg(F.array_sort(F.collect_list("_near")).alias("_near"))

    def work(frames):
        for frame in frames:
            gone = [
                verdict(r.path, r.sign, list(r.hashes), list(r.kinds), [(n["path"], n["sign"], list(n["hashes"])) for n in r.near], copy_share)
                for r in frame.rename(columns=lambda name: name.lstrip("_")).itertuples(index=False)
            ]
            yield pd.DataFrame({"_host": frame["_host"], "_same": frame["_same"], "_gone": gone})

    found = met.mapInPandas(work, "_host string, _same binary, _gone array<int>").where(F.size("_gone") > 0)
    return members.join(found, ["_host", "_same"]).select("_t", "_gone")


def kept_text(lines: list[tuple[str, int]], gone) -> str:
    """Lines of article elements are the article; a page without one keeps all plain lines that are left."""
    some, gone = any(p == ARTICLE for _, p in lines), set(gone)
    return "\n".join(t for k, (t, p) in enumerate(lines) if k not in gone and p == (ARTICLE if some else PLAIN))


def extract(pages: DataFrame, reach: int = 2, copy_share: float = 0.5, id_col="page_id", url_col="url", html_col="html", bits: int = 24) -> DataFrame:
    """(id, url, text, n_lines, n_deleted) for each page; with reach 0 nothing is deleted by differencing."""
    rows = plain(pages, id_col, url_col, html_col)
    outline = kernel.written(outlines(rows), "outlines")
    gone = verdicts(outline, reach, copy_share, bits) if reach else outline.select("_t", F.array().cast("array<int>").alias("_gone")).limit(0)
    gone = kernel.written(gone, "verdicts")
    kernel.discard(outline)
    flags = kernel.bitmap(gone.select(lead("_t").alias("m")), "m", bits)
    kind = rows.schema["_key"].dataType.simpleString()

    # pages that lose no line are done where they are; of the others what may be text moves to its verdict, compressed
    def pick(hit: bool):
        def work(batches):
            for batch in batches:
                batch = batch.filter(pa.array(kernel.in_bitmap(flags, batch.column(4).to_numpy(), bits) == hit))
                found = [all_lines(h) for h in batch.column(2).to_pylist()]
                sizes = pa.array([len(f) for f in found], pa.int32())
                text = [None if hit else kept_text(f, ()) for f in found]
                lines = [zstandard.ZstdCompressor(level=3).compress(json.dumps([(t, p) if p != FRAME else ("", p) for t, p in f], ensure_ascii=False).encode()) if hit else None for f in found]
                columns = [batch.column(0), batch.column(1), pa.array(text, pa.string()), sizes, batch.column(3), pa.array(lines, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["_key", "_url", "text", "n_lines", "_t", "_lines"])

        return rows.mapInArrow(work, f"_key {kind}, _url string, text string, n_lines int, _t binary, _lines binary")

    def finish(batches):
        for batch in batches:
            text = []
            for size, packed, own in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                raw = zstandard.ZstdDecompressor().decompress(packed)
                text.append(kept_text([tuple(x) for x in json.loads(raw)], own or ()))
            count = pa.array([len(own or ()) for own in batch.column(5).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), batch.column(3), count], names=["_key", "_url", "text", "n_lines", "n_deleted"])

    clear = pick(False).select("_key", "_url", "text", "n_lines", F.lit(0).alias("n_deleted"))
    other = pick(True).join(gone, "_t", "left").select("_key", "_url", "text", "n_lines", "_lines", "_gone")
    other = other.mapInArrow(finish, f"_key {kind}, _url string, text string, n_lines int, n_deleted int")
    return clear.unionByName(other).withColumnsRenamed({"_key": id_col, "_url": url_col})

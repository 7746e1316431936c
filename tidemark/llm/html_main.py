"""Main text of pages: nearest-URL page differencing over lines, together with what the markup itself says.

One pass reads the markup: elements that are menus, headers, footers, sidebars, notices, adverts, forms, scripts or comments
by tag, role or class never count, and lines inside an article or main element are told from others. Every page is then
differenced: distinct pages of a host are sorted by URL path, each is paired with the neighbour whose path shares the
longest prefix among ``AROUND`` on each side, lines of the two are aligned by longest common subsequence and the shared
ones are deleted. A check follows for pages with an article: only its lines are text, and a deleted one comes back unless
all unlike neighbours share it. Neighbours are found by global ordinals, with the pages around a block copied to it, so the
result does not depend on partitions. Lines move as 64-bit hashes and lengths; texts stay where they were parsed.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ordinals import numbered
from tidemark.llm.skew import spread_join
from tidemark.llm.store import stored
from tidemark.llm.url_rules import split_urls

# A quote opens a value only after an equals sign.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>]*)|[^>=])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?")
RAW = {"script", "style", "noscript", "template", "title", "textarea", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "input", "link", "meta", "source", "ruby", "rt", "rp", "nobr"}
OUT_TAGS = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "svg", "object", "audio", "video", "canvas", "fieldset", *RAW}
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "status"}
OUT_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "notice", "notices", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "alert", "comment", "comments", "reply", "replies", "respond", "disqus", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "search", "pagination", "pager", "toolbar", "widget", "skip"}
#: A class of several parts is out if all its parts are of the words above or below and one of those above, so market-share stays.
OUT_PARTS = {"site", "page", "main", "top", "bottom", "left", "right", "global", "primary", "secondary", "post", "posts", "article", "articles", "list", "item", "items", "box", "block", "container", "wrapper", "wrap", "inner", "area", "section", "bar", "button", "buttons", "link", "links", "icons", "media", "content", "body", "form", "thread", "slot", "unit", "text", "title"}
MAIN_TAGS = {"article", "main"}
#: An open paragraph ends where one of these begins.
CLOSES_P = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "aside", "footer", "header", "nav", "form", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "hr", "main", "figure", "address", "fieldset"}
#: An end tag does not reach out of these.
FENCE = {"article", "main", "body", "html", "table", "nav", "footer", "header", "aside", "section"}
SPACE = re.compile(r"\s+")
#: Different pages on each side of a page among which its mate is looked for; a page that shares more of the own characters is a near copy.
AROUND, NEAR_COPY = 8, 0.9
#: A page that shares more of an article's characters is a version of it; so many others have to share a line of an article that goes.
VERSION, WITNESSES = 0.5, 3


def _out_name(name: str) -> bool:
    parts = [x for x in re.split(r"[-_]+", name) if x]
    return name in OUT_WORDS or len(parts) > 1 and any(x in OUT_WORDS for x in parts) and all(x in OUT_WORDS or x in OUT_PARTS for x in parts)


def _out(tag: str, attributes: str) -> bool:
    if tag in OUT_TAGS:
        return True
    if not attributes or tag in ("html", "body", "article", "main") and "comment" not in attributes:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value.strip() in OUT_ROLES:
            return True
        if name in ("class", "id") and any(map(_out_name, value.split())):
            return True
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


def blocks(page: str) -> list[tuple[str, bool]]:
    """(text, inside an article or main element) of the blocks of a page that are not excluded, in page order."""
    out: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, excluded, main; the last two with all above
    text: list[str] = []
    excluded = main = False
    at, n = 0, len(page)

    def flush() -> None:
        if text:
            own = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if own:
                out.append((own, main))
            text.clear()

    def pop_to(k: int) -> None:
        nonlocal excluded, main
        del stack[k:]
        excluded, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)

    while at < n:
        m = TAG.search(page, at)
        if not excluded and at < (end := m.start() if m else n):
            text.append(page[at:end])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if stack[k][0] in FENCE and tag not in FENCE:
                    break
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if tag in VOID or m[3].rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        stack.append((tag, excluded or _out(tag, m[3]), main or tag in MAIN_TAGS))
        excluded, main = stack[-1][1], stack[-1][2]
    flush()
    return out


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b`` (Hunt and Szymanski, ends trimmed)."""
    lo, n, m = 0, len(a), len(b)
    while lo < n and lo < m and a[lo] == b[lo]:
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    out = set(range(lo)) | set(range(n, len(a)))
    where: dict[str, list[int]] = defaultdict(list)
    for j in range(m - 1, lo - 1, -1):
        where[b[j]].append(j)
    ends: list[int] = []
    links: list[tuple | None] = []
    for i in range(lo, n):
        for j in where.get(a[i], ()):
            k = bisect_left(ends, j)
            node = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(node)
            elif j < ends[k]:
                ends[k], links[k] = j, node
    node = links[-1] if links else None
    while node:
        out.add(node[0])
        node = node[1]
    return out


def common_prefix(a: str, b: str) -> int:
    k = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        k += 1
    return k


def deleted(lines: list, sizes: list[int], main: list[bool], mates: Iterable[list]) -> list[int]:
    """Places of the lines of a page that go as its mates share them; of a page with an article, places of its lines only.

    ``mates`` come best first. The first that is no near copy of the page counts; of near copies alone, the one that
    shares least, as what all of a host's short pages share is no text. A page that holds all lines of this one is a copy.
    Lines in an article are checked: a mate that shares more than ``VERSION`` of it is a version of it and does not count,
    and the lines that the first other one shares go if all others around, and ``WITNESSES`` of them at least, share them.
    """
    at = [k for k, m in enumerate(main) if m]
    if at:
        own, size, seen, gone = [lines[k] for k in at], sum(sizes[k] for k in at), 0, set()
        for mate in mates:
            found = shared_lines(own, mate)
            if sum(sizes[at[k]] for k in found) <= VERSION * size:
                seen, gone = seen + 1, gone & found if seen else found
                if not gone:
                    break
        return sorted(at[k] for k in gone) if seen >= WITNESSES else []
    size = sum(sizes)
    least, shared = size, set()
    for mate in mates:
        found = shared_lines(lines, mate)
        held = sum(sizes[k] for k in found)
        if len(found) < len(lines) and held < least:
            least, shared = held, found
            if held <= NEAR_COPY * size:
                break
    return sorted(shared)


def main_text(own: list[tuple[str, bool]], mates: Iterable[list[tuple[str, bool]]] | None) -> str:
    """Lines of a page without those that go by its mates; with an article, its lines and no others."""
    lines, main = [t for t, _ in own], [m for _, m in own]
    gone = set(deleted(lines, [len(t) for t in lines], main, ([t for t, _ in mate] for mate in mates or ())))
    whole = any(main)
    return "\n".join(t for k, (t, m) in enumerate(own) if k not in gone and (m or not whole))


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path, lines, main): the lines of every page and whether an article or main element holds them; null without a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                own = [blocks(page or "") for page in part.column(4).to_pylist()]
                lines, main = ([[x[i] for x in page] or None for page in own] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(lines, pa.list_(pa.string())), pa.array(main, pa.list_(pa.bool_()))], names=["page_id", "url", "host", "path", "lines", "main"])

    kind = dict(pages.dtypes)["page_id"]
    rows = split_urls(pages.select("page_id", "url", "html")).select("page_id", "url", "host", "path", "html")
    return rows.mapInArrow(run, f"page_id {kind}, url string, host string, path string, lines array<string>, main array<boolean>")


def differenced(pages: DataFrame, block: int = 512) -> DataFrame:
    """(host, l1, l2, n, gone) of the distinct (host, l1, l2) of ``pages`` (page_id, host, path, keys, sizes, main, l1, l2).

    ``keys`` tell lines apart, ``gone`` has the places of those that go; n counts the rows.
    """
    distinct = pages.groupBy("host", "l1", "l2").agg(F.min(F.struct("path", "page_id")).alias("at"), F.count("*").alias("n"), F.first(F.struct("keys", "sizes", "main")).alias("own"))
    order, total = numbered(distinct.select("host", "at.path", "at.page_id", "l1", "l2", "n", "own.*"), ["host", "path", "page_id", "l1", "l2"], "order")
    last = max(0, (total - 1) // block)
    own = F.floor(F.col("g") / block).cast("long")
    around = [F.greatest(F.floor((F.col("g") - AROUND) / block).cast("long"), F.lit(0).cast("long")), own, F.least(F.floor((F.col("g") + AROUND) / block).cast("long"), F.lit(last).cast("long"))]
    copied = order.withColumn("own", own).withColumn("block", F.explode(F.array_distinct(F.array(*around))))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("g")
        hosts, paths, keys, sizes, main = (rows[c].tolist() for c in ("host", "path", "keys", "sizes", "main"))
        keys = [k.tolist() for k in keys]
        out = []
        for k in np.flatnonzero((rows["own"] == rows["block"]).to_numpy()).tolist():
            mates = [j for j in range(max(0, k - AROUND), min(len(rows), k + AROUND + 1)) if hosts[j] == hosts[k] and j != k]
            mates.sort(key=lambda j: (-common_prefix(paths[j], paths[k]), abs(j - k), j))
            out.append((k, deleted(keys[k], sizes[k].tolist(), main[k].tolist(), (keys[j] for j in mates))))
        found = rows[["host", "l1", "l2", "n"]].iloc[[k for k, _ in out]].copy()
        found["gone"] = [g for _, g in out]
        return found

    return stored(copied.groupBy("block").applyInPandas(run, "host string, l1 long, l2 long, n long, gone array<int>"), "differenced")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    A null html is empty and gives an empty text; pages without a host form one group; a page that is alone on its host
    is not differenced. Copies (pages of a host with the same lines) are one page, at the least of their paths, so a page
    that has only copies around it keeps all lines. Very long pages are read whole. Other columns are ignored; repeated
    rows come back as often.
    """
    rows = stored(parsed(pages), "pages").withColumn("l1", F.xxhash64("lines", "main")).withColumn("l2", F.xxhash64(F.lit(1), "lines", "main"))
    keys = F.transform("lines", lambda x: F.xxhash64(x))
    slim = rows.filter("lines is not null").select("page_id", "host", "path", keys.alias("keys"), F.transform("lines", lambda x: F.char_length(x)).alias("sizes"), "main", "l1", "l2")
    # Pages that keep all they have need no join: where few lose lines, these are broadcast and the texts stay in place.
    losing = stored(differenced(slim).filter(F.size("gone") > 0), "losing")
    found = spread_join(rows.filter("lines is not null"), losing, ["host", "l1", "l2"], ["page_id", "url"])
    gone, whole = F.coalesce("gone", F.array().cast("array<int>")), F.exists("main", lambda m: m)
    counted = F.filter(F.arrays_zip("lines", "main", F.sequence(F.lit(0), F.size("lines") - 1).alias("k")), lambda x: (x["main"] | ~whole) & ~F.array_contains(gone, x["k"]))
    text = F.array_join(F.transform(counted, lambda x: x["lines"]), "\n")
    every = found.select("page_id", "url", text.alias("text")).unionByName(rows.filter("lines is null").select("page_id", "url", F.lit("").alias("text")))
    return every.withColumn("n_chars", F.char_length("text").cast("long"))


def op4_html_main_text(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))

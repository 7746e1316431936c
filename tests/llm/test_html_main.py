import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import html_main as H


def text(page):
    return H.main_text(H.blocks(page), None)


def test_article_only():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var t="</p>";</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div>
    <article><h1>Head &amp; line</h1><p><b>One   two<p>three&nbsp;four<br>five<aside>side</aside><form>name <input></form>
    <div class="cookie-notice">cookies</div><section id="comments"><p>first!</p></section><p>six &#233;</article>
    <div id="sidebar">more</div><footer>&copy; x</footer>"""
    assert text(page) == "Head & line\nOne two\nthree four\nfive\nsix é"


def test_broken_pages():
    assert text("") == "" and text("plain < text") == "plain < text"
    assert text("<article><p>cut &am") == "cut &am"
    assert text("<article>a<script>x") == "a"
    assert text("<article>a<!-- x") == "a"
    assert text("<article>a</div></p></article>b") == "a"
    assert text("<nav>menu<p>still</nav><p>after") == "after"
    assert text("<article class='comment'>c</article><main>m</main>") == "m"
    assert text("<p>a<div hidden>b</div>c<p aria-hidden='true'>d") == "a\nc"
    assert text("<textarea><p>x</textarea><p>y <a href='>'>z</a>") == "y z"


def test_attributes_that_only_look_like_boilerplate():
    assert text('<article><p title="the hidden truth">a<p class="market-share">b<p class="ad-hoc x">c<p id=related-work>d</article>') == "a\nb\nc\nd"
    assert text("<article><p title=don't>one</p><p>two's</p></article>") == "one\ntwo's"
    assert text('<article>a<div class="site-footer">b</div><div class="x share-buttons">c</div><p HIDDEN>d</p><p class=ad>e</p></article>') == "a"


def slow_text(rows, around=8):
    """The method by its words: distinct pages of a host by path, the nearest different neighbours, deletion of shared lines."""
    own = {k: H.blocks(h or "") for k, _, h in rows}
    place = {}
    for k, u, _ in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        place[k] = (m[1].lower(), m[2]) if m else ("", "")
    groups = {}
    for k, _, _ in sorted(rows, key=lambda r: (place[r[0]], r[0])):
        if own[k] and not any(m for _, m in own[k]):
            groups.setdefault((place[k][0], tuple(t for t, _ in own[k])), []).append(k)
    order = sorted(groups.items(), key=lambda g: (g[0][0], place[g[1][0]][1], g[1][0]))
    out = {k: "\n".join(t for t, m in own[k] if m) for k in own}
    for i, ((host, lines), members) in enumerate(order):
        mates = [j for j in range(max(0, i - around), min(len(order), i + around + 1)) if j != i and order[j][0][0] == host]
        path = lambda j: place[order[j][1][0]][1]
        mates.sort(key=lambda j: (-H.common_prefix(path(j), path(i)), abs(j - i), j))
        got = H.main_text([(t, False) for t in lines], [[(t, False) for t in order[j][0][1]] for j in mates])
        out |= dict.fromkeys(members, got)
    return out


def test_the_method_on_pages_without_markup_at_any_partitioning(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    strip = lambda h: re.sub(r"</?(article|main|nav|footer|header|aside)\b", "<div", h or "")
    rows = [(r["page_id"], r["url"], "<div>Same menu<p>of all</p></div>" + strip(r["html"])) for r in pages]
    want = slow_text(rows)
    for n, block in ((1, 512), (13, 9)):
        docs = frame(spark, rows).repartition(n)
        parsed = H.parsed(docs)
        assert parsed.filter("lines is not null").count() == len(rows)  # differencing decides every page
        old = H.differenced.__defaults__
        H.differenced.__defaults__ = (block,)
        try:
            found = {r["page_id"]: r["text"] for r in H.extract_main_text(docs).collect()}
        finally:
            H.differenced.__defaults__ = old
        assert found == want
    alone = {r["page_id"] for r in pages if [x["url"].split("/")[2] for x in pages].count(r["url"].split("/")[2]) == 1}
    assert all(not t.startswith("Same menu\nof all") for k, t in want.items() if k not in alone) and len(alone) < len(rows)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
def test_shared_lines_are_a_longest_common_subsequence(a, b):
    found = sorted(H.shared_lines(a, b))
    assert len(found) == lcs(a, b)
    rest = iter(b)
    assert all(a[k] in rest for k in found)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, text int")


def test_neighbours_by_path_lose_what_they_share(spark):
    page = lambda own: f"<div>Top<p>Menu</p></div><div><p>{own}</p></div><div>Bottom</div>"
    rows = [(1, "http://a.com/x/1", page("one")), (2, "http://a.com/x/2", page("two")), (3, "http://A.com/y", page("three")), (4, "http://b.com/x/1", page("alone")), (5, None, None), (6, "u", "<article>" + "long " * 100_000)]
    found = {r["page_id"]: r for r in H.extract_main_text(frame(spark, rows).coalesce(1)).collect()}
    assert found[1]["text"] == "one" and found[2]["text"] == "two" and found[3]["text"] == "three"
    assert found[4]["text"] == "Top\nMenu\nalone\nBottom" and found[5]["text"] == "" and found[5]["n_chars"] == 0
    assert found[6]["n_chars"] == 499_999
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())


def test_copies_of_an_article_are_kept(spark):
    rows = [(k, f"http://a.com/{k}", "<nav>m</nav><article><p>same</p></article>") for k in (1, 2, 2)]
    assert [r["text"] for r in H.extract_main_text(frame(spark, rows)).collect()] == ["same"] * 3
    assert H.extract_main_text(frame(spark, rows).limit(0)).collect() == []


def test_query(spark, data):
    import html

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in H.op4_html_main_text(spark, data).collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]]["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", body)]
        assert r["text"] == "\n".join(x for x in parts if x) and r["url"] == pages[r["page_id"]]["url"]


def test_copies_without_an_article_keep_their_text(spark):
    page = lambda own: f"<div>Top<p>Menu</p></div><div><p>{own}</p></div><div>Bottom</div>"
    found = lambda pages: [r["text"] for r in sorted(H.extract_main_text(frame(spark, [(k, f"http://a.com/x/{k:03}", p) for k, p in enumerate(pages)]).coalesce(1)).collect(), key=lambda r: r["page_id"])]
    assert found([page("same")] * 3) == ["Top\nMenu\nsame\nBottom"] * 3
    assert found([page("same")] * 40 + [page("other")]) == ["same"] * 40 + ["other"]
    assert found([page("a"), page("b")] * 3) == ["a", "b"] * 3
    long = "word " * 40
    versions = [page(f"{long}</p><p>version {k}") for k in range(3)]
    assert found([*versions, page("other")]) == [*[f"{long.strip()}\nversion {k}" for k in range(3)], "other"]
    assert found([page("t" * 90 + f"</p><p>{k}") for k in range(3)]) == ["0", "1", "2"]
    many = [page(f"own text {k}") for k in range(30)]
    assert found(many) == [f"own text {k}" for k in range(30)]


def test_pages_with_an_article_are_differenced_too(spark):
    page = lambda own: f"<article><p>{own}</p><p>Tell your friends</p></article>"
    long = "all of the very same words " * 4
    own = [f"own text of number {k}, which is longer" for k in range(5)]
    rows = [(k, f"http://a.com/x/{k}", page(t)) for k, t in enumerate(own)]
    rows += [(10 + k, f"http://b.com/{k}", f"<article><p>{long}</p><p>version {k}</p></article>") for k in range(5)]
    rows += [(20 + k, f"http://c.com/{k}", page(own[k])) for k in range(3)]  # too few to tell
    found = {r["page_id"]: r["text"] for r in H.extract_main_text(frame(spark, rows).repartition(3)).collect()}
    assert [found[k] for k in range(5)] == own
    assert [found[10 + k] for k in range(5)] == [f"{long.strip()}\nversion {k}" for k in range(5)]
    assert [found[20 + k] for k in range(3)] == [f"{t}\nTell your friends" for t in own[:3]]

import html
import html.parser
import re
import time

import pytest

from quillon.llm import html_extract as h


def own(source):
    page = h.Page(source)
    return page.main_text(page.path()[0])


@pytest.mark.parametrize(
    "source, want",
    [
        ("", ""),
        ("plain text", "plain text"),
        ("<p>a&nbsp;b\n c<p>d&amp;&lt;i&gt; <b>bo</b>ld<br>x", "a b c d&<i> bold x"),
        ("<article><h1>T</h1><p>one</p><nav>menu</nav><div class='ad-box'>buy</div><p>two</article><footer>f</footer>", "T one two"),
        ("<body><div id=sidebar>links</div><main><p>text text</p><form>f<input></form></main><div class=comments><p>c</p></div>", "text text"),
        ("<script>var x='</p><p>no';</script><style>p{}</style><p>yes</p><!-- <p>no</p> --><p>more</p><p", "yes more"),
        ("<p title='a > b' class=\"x\">in</p> 3 < 4 <3", "in 3 < 4 <3"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a b c d e"),
        ("<div>x</span></b>y</div></div>z", "xy z"),
        ("<title>no", ""),
        ("<p>cut &amp", "cut &"),
        ("<p>&#233;&#x41;&bogus;</p>", "éA&bogus;"),
    ],
)
def test_text(source, want):
    assert own(source) == want


def test_linear_time():
    began = time.time()
    for source in ("<div>" * 50000, "</p>" * 10**5, '<a b="' * 10**5, "<" * 10**6, "<!--" * 10**5, "<p><b>x" * 10**5,
                   "<script>" * 50000, "<li>" * 50000, "x " * 10**6, "&" * 10**5, "<a =" * 10**5, "<x class=" + "a" * 10**6):
        own(source)
    assert time.time() - began < 30


def test_host_consensus(spark):
    usual = "<div class='post-{0}'><p>{1}</p></div><div class=extra><p>{2}</p></div>"
    rows = [(i, "http://a.b/x", usual.format(i, "good text " * 9, "more")) for i in range(6)]
    # on this page something else is larger, yet the host's path wins
    rows += [(6, "http://A.B/y", usual.format(6, "short", "a very long promotion of nothing " * 20))]
    rows += [(7, None, None), (8, "", ""), (9, "http://c.d/", "<p>alone</p>"), (9, "http://c.d/", "<p>alone</p>")]
    pages = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id int, url string, html string, main_text string, _host string")
    got = sorted((r[0], r[1]) for r in h.extract(pages, ["page_id"]).collect())
    assert got[6] == (6, "short") and got[0] == (0, ("good text " * 9).strip())
    assert got[7:] == [(7, ""), (8, ""), (9, "alone"), (9, "alone")]
    assert h.extract(pages.limit(0), ["page_id"]).count() == 0
    assert h.extract(pages, ["page_id", "_host"]).count() == 11
    clash = pages.selectExpr("*", "1 AS winner", "2 AS host", "3 AS path")
    out = h.extract(clash, clash.columns)
    assert out.columns == ["page_id", "url", "html", "_host", "winner", "host", "path", "main_text"] and out.count() == 11
    assert h.extract(pages, ["page_id", "main_text"], name="body").columns == ["page_id", "main_text", "body"]


def test_query_against_a_plain_reading(spark):
    from quillon.llm.queries import QUERIES

    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    out = QUERIES["op1_html_extract"](spark, "/root/testdata/sf0.01").collect()
    assert len(out) == len(pages)
    for r in out:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id].html, re.S).group(1)
        inner = re.sub(r"<[^>]*\Z", "", re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1)>", "\x01", inner.replace("<br>", " "))))
        want = " ".join(" ".join(html.unescape(b).split()) for b in inner.split("\x01") if b.split())
        assert (r.text, r.n_chars, r.url) == (want, len(want), pages[r.page_id].url)


def test_titles_and_leads_around_most_of_the_text():
    body = "good text " * 40
    post = "<div class=post><h1>Title</h1><p class=lead>intro</p><div class=post-body><p>%s</p></div><p>end</p>%s</div>"
    want = f"Title intro {body.strip()} end"
    assert own("<body>" + post % (body, "")) == want
    # links around the text are no part of it, and nothing else goes with them
    assert own("<body><div class=page>" + post % (body, "<p><a href=x>one</a> <a href=y>two</a></p>") + "</div>") == want
    assert own(f"<body><h1>Title</h1><p>intro</p><div class=post-body><p>{body}</p></div>") == f"Title intro {body.strip()}"


@pytest.mark.parametrize(
    "tag", ['div class="content has-sidebar"', 'main class="no-sidebar"', 'article class="post comments-open"',
            "div class=header-layout", 'div id="page-with-menu"', 'article class="related"', "div class=ad><div class=promo"],
)
def test_marks_spare_the_main_text(tag):
    end = "</div></body>" if tag.startswith("div") else f"</{tag.split()[0]}></body>"
    page = f"<body><{tag}><h1>T</h1><p>{'good text ' * 20}</p><div class=sidebar>links</div><p>end</p>{end}"
    assert own(page) == f"T {('good text ' * 20).strip()} end"


def test_marks_still_drop():
    long = "said a reader " * 40
    assert own(f"<article><p>short text</p></article><div class=comments><p>{long}</p></div>") == "short text"
    assert own("<p>text</p><div class=menu><a href=x>" + long + "</a></div>") == "text"
    began = time.time()
    own("<div class=ad>x" * 50000)
    assert time.time() - began < 10


LONG = "good text " * 40


@pytest.mark.parametrize(
    "source, want",
    [
        ('<article class="related-work"><p>a b</p></article>', "a b"),
        ('<div class="content share"><p>a b</p></div><div class=share>x</div>', "a b"),
        ('<article><p class="lead notice-period">lead</p><p>a b</p></article>', "lead a b"),
        (f'<article><p>{LONG}</p><div class="search-results-analysis"><p>a b</p></div></article>', LONG + "a b"),
        (f'<article><p>{LONG}</p><ul class="menu-items"><li>soup</ul></article>', LONG + "soup"),
        (f"<div class=page><p>{'first ' * 50}</p><div class=rest><p>{'good text ' * 200}</p></div></div>", "first " * 50 + ("good text " * 200).strip()),
        (f"<body><p>{'first ' * 50}</p><div class=rest><p>{'good text ' * 200}</p></div>", "first " * 50 + ("good text " * 200).strip()),
        # names of boilerplate still mark it
        (f'<article><p>{LONG}</p><div class="share-buttons">x</div><div id="relatedPosts">x</div><div class="post comment-list">x</div><p>end</p></article>', LONG + "end"),
        (f'<div class=page><p>{LONG}</p><div class="cookie-notice bar">x</div><div class="site-footer">x</div><div role=navigation>x</div></div>', LONG.strip()),
    ],
)
def test_names_that_only_sound_like_boilerplate(source, want):
    assert own(source) == want


def test_usual_names_of_boilerplate():
    names = """ad-box ad-300x250 ads-by-google adsbygoogle banner-ad promo-teaser sponsored-content sidebar sidebar-right left-sidebar site-header page-header
        header-top main-navigation primary-menu dropdown-menu nav-tabs breadcrumb-trail site-footer footer-copyright related-posts relatedArticles related-topics
        recommended-for-you share-this social-media social-share-buttons newsletter-signup email-signup login-form search-box alert alert-warning notice
        site-notice cookie-consent cookie-law-info gdpr modal-dialog popup-overlay pagination pager-next comments comment-list commentlist user-comments
        disqus_thread comment-respond reader-comments facebook-comments""".split()
    for name in names:
        for attribute in ("class", "id"):
            page = f"<div class=page><p>{LONG}</p><div {attribute}='{name}'><p>not this</p></div><p>end</p></div>"
            assert own(page) == LONG + "end", name
    for name in ("lead", "notice-period", "menu-items", "search-results", "header-layout", "share-price", "pop-up-restaurant", "alert-level-analysis", "comments-open", "has-sidebar", "no-menu"):
        page = f"<div class=page><p>{LONG}</p><div class='{name}'><p>this</p></div><p>end</p></div>"
        assert own(page) == LONG + "this end", name


class Tree(html.parser.HTMLParser):
    """A plain reading of well-formed pages of div and p: (path, containers around) of each p's text."""

    def __init__(self, source):
        super().__init__()
        self.open, self.found, self.count = [], [], 0
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        names = dict(attrs).get("class", "")
        self.count += 1
        self.open.append((tag + ("." + re.sub("[0-9]+", "#", names.split()[0]) if names else ""), self.count))

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        boxes = [x for x in self.open if not x[0].startswith("p")]
        self.found.append((data, boxes))


def path(boxes):
    return "".join("/" + name for name, _ in boxes)


def voted(tree):
    """The path of the deepest container with most of the text, the last of several."""
    total = sum(len(t.strip()) for t, _ in tree.found)
    held = {}
    for t, boxes in tree.found:
        for size in range(len(boxes) + 1):
            key = tuple(boxes[:size])
            held[key] = held.get(key, 0) + len(t.strip())
    return path(max((k for k, n in held.items() if n >= h.MOST * total), key=lambda k: (len(k), k[-1][1] if k else 0)))


def text_of(tree, winner):
    cores = {tuple(b[: i + 1]) for _, b in tree.found for i in range(len(b)) if path(b[: i + 1]) == winner}
    if not cores:
        own_path = voted(tree)
        cores = {tuple(b[: i + 1]) for _, b in tree.found for i in range(len(b)) if path(b[: i + 1]) == own_path}
    # around each: the highest container below body; what stands in body itself belongs to the text
    tops = {c[: min(len(c), 3)] for c in cores}
    return " ".join(" ".join(t.split()) for t, b in tree.found if len(b) < 3 or any(tuple(b[: len(top)]) == top for top in tops))


def test_consensus_against_a_plain_version(spark):
    import random
    from collections import Counter

    rng = random.Random(9)
    words = lambda n: " ".join(rng.choice(["river", "stone", "house", "light"]) for _ in range(n))
    pages = []
    for i in range(240):
        host, parts = f"h{i % 6}.org", []
        if i % 6 % 2:
            parts.append(f"<p>{words(3)}</p>")
        inner = f"<p>{words(rng.randint(5, 80))}</p><div class=rest-{i}><p>{words(rng.randint(1, 300))}</p></div>"
        parts.append(f"<div class=post-{i}>{inner}</div>")
        # on some pages something else is larger than the post
        parts.append(f"<div class=extra><p>{words(2000 if rng.random() < 0.2 else 4)}</p></div>")
        if rng.random() < 0.1:
            parts = [f"<div class=other><p>{words(30)}</p></div>"]
        pages.append((i, f"http://{host}/{i}", "<html><body>" + "".join(parts) + "</body></html>"))
    trees = {i: Tree(source) for i, _, source in pages}
    ballots = {}
    for i, url, _ in pages:
        ballots.setdefault(url.split("/")[2], Counter())[voted(trees[i])] += 1
    winner = {host: min(b, key=lambda p: (-b[p], p)) for host, b in ballots.items()}
    got = {r.page_id: r.main_text for r in h.extract(spark.createDataFrame(pages, "page_id int, url string, html string"), ["page_id"]).collect()}
    alone = {i: text_of(trees[i], None) for i in trees}
    want = {i: text_of(trees[i], winner[url.split("/")[2]]) for i, url, _ in pages}
    assert got == want
    # the vote decides, and it decides for the post
    changed = [i for i in want if want[i] != alone[i]]
    assert 20 < len(changed) and all("rest" in winner[f"h{i % 6}.org"] or "post" in winner[f"h{i % 6}.org"] for i in changed)

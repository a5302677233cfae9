import random
import time

import pytest

from fidelis.llm import htmlwrap as H

ROWS = "page_id long, url string, html string, text string"


def page(i, extra="", tail="</body></html>"):
    ps = "".join(f"<p>Paragraph {i}-{k} says <b>something</b> rather &amp; long about the matter.</p>" for k in range(3 + i % 4))
    links = "".join(f'<li><a href="/{k}">link {k}</a></li>' for k in range(3 + i % 2))
    return (
        f'<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Site</header>'
        f'<nav><ul>{links}</ul></nav><!-- ad {i} --><div class="ad">Buy {i}!</div>{extra}<article><h1>Title {i}</h1>{ps}</article>'
        f'<div class="comments"><p>Reader {i} says no</p></div><footer>&copy; {i}</footer>{tail}'
    )


def want(i):
    return "\n".join([f"Title {i}", *(f"Paragraph {i}-{k} says something rather & long about the matter." for k in range(3 + i % 4))])


def test_articles(spark):
    rows = [(i, "https://a.example/x", page(i, '<div class="cookie-notice">ok?</div>' if i % 3 else ""), "clash") for i in range(12)]
    rows += [(50 + i, "http://b.example:80/", page(i, tail=""), "") for i in range(3)]
    rows += [(90, None, None, ""), (91, "", "", ""), (92, "x", "  \n ", ""), (93, "http://c", "plain   text\n only", ""), (94, "http://a.example/", "<p>odd one <i>out</i></p>", ""), (None, "http://a.example", page(2), "")]
    got = {r.page_id: r for r in H.extract(spark.createDataFrame(rows, ROWS)).collect()}
    for i in range(12):
        assert got[i].text == want(i) and got[i].n_chars == len(want(i))
    assert all(got[50 + i].text == want(i) for i in range(3))
    assert [got[i].text for i in (90, 91, 92, 93, 94, None)] == ["", "", "", "plain text only", "odd one out", want(2)]
    assert H.extract(spark.createDataFrame([], ROWS)).count() == 0


def test_malformed():
    bad = "<body><article><h1>H</h1><p><b>first.<br><p>second &eacute;&#233;&nbsp;x</p><ul><li>one<li>two</ul><p>a<p>b</article><footer>f"
    assert H.main_text(bad, None) == "H\nfirst.\nsecond éé x\none\ntwo\na\nb"
    assert H.main_text("<p>" * 3000 + "deep", None) == "deep"
    assert H.main_text("<div>" * 20_000 + "deep", None) == "deep"
    assert H.main_text("<!-- never closed <p>x</p>", None) == ""
    assert len(H.main_text("<article>" + "<p>long text here</p>" * 50_000 + "</article>", None)) == 50_000 * 15 - 1


def test_without_article_element():
    body = '<div id="menu">Home</div><div class="post"><p>{0}</p><p>{1}</p></div><div class="sidebar"><p>other</p></div>'
    pages = [f"<html><body>{body.format('words of the text ' * (5 + i), 'more of it ' * 9)}</body></html>" for i in range(4)]
    wrapper = None
    for p in pages:
        own = H.fold(H.parse(p))
        wrapper = own if wrapper is None else H.merge(wrapper, own)
    assert H.main_path(wrapper) == ["html", "body", "div.post"]
    assert H.main_text(pages[0], H.rules(wrapper, 4)).startswith("words of the text")


def test_wrapper_expression():
    a = H.fold(H.parse("<ul><li>x</li><li>y</li></ul><div>t</div>"))
    b = H.fold(H.parse("<ul><li>x</li></ul><h2>new</h2><div>u</div>"))
    assert H.expression(H.merge(a, b)) == "<#root>(<ul>(<li>(#)+)<h2>(#)?<div>(#))"


@pytest.mark.parametrize("tag", ["nav", "aside", "footer", "form"])
def test_noise_elements(tag):
    assert H.main_text(f"<body><{tag}>menu menu menu menu</{tag}><main><p>text of the page</p></main></body>", None) == "text of the page"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<body><div class="content no-sidebar"><p>the text of it</p></div></body>', "the text of it"),
        ('<body><div class="post with-comments"><p>the text of it</p></div><div class="comments">me too</div></body>', "the text of it"),
        ('<body><div class="legal-article"><p>the text of it</p></div></body>', "the text of it"),
        ('<body><form id="aspnetForm"><div id="menu">Home</div><article><p>the text of it</p></article></form></body>', "the text of it"),
        ('<body><article><p>a</p><p class="share-price">12 euros</p></article></body>', "a\n12 euros"),
        ("<body><article><p>a</p><svg/><p>b</p></article></body>", "a\nb"),
        ("<body><article><p>a</p><object data=x><p>b</p></article></body>", "a\nb"),
        ("<body><article><p>a</p><svg><text>no</text></svg><p>b</p></article></body>", "a\nb"),
        ('<body><article><p title="x < y > z">a</p></article></body>', "a"),
        ("<body><article><p>a</p><!-- <p>no</p> --><script>if (a < b) '<p>no</p>'</script>b</article>", "a\nb"),
        ('<body><div class="post"><h1>Head</h1><p class="lead">lead text</p><div class="body"><p>' + "long text " * 50 + "</p></div></div></body>", "Head\nlead text\n" + ("long text " * 50).strip()),
        ("<body><main><h1>Head</h1><article><p>" + "long text " * 50 + "</p></article></main></body>", "Head\n" + ("long text " * 50).strip()),
        ('<body><div class="sidebar"><p>side</p></div><div class="share-buttons">x</div><p>the text of it</p></body>', "the text of it"),
    ],
)
def test_articles_that_look_like_noise(html, text):
    assert H.main_text(html, None) == text


@pytest.mark.parametrize("part", ["<a ", '<a "', "<a '", "<a b=\"c", "<!--", "<svg>", "<script", "<p><", "</p", "<li>", "<object>"])
def test_broken_markup_takes_linear_time(part):
    begin = time.perf_counter()
    H.main_text("<article><p>text</p>" + part * (1_000_000 // len(part)), None)
    assert time.perf_counter() - begin < 20
    begin = time.perf_counter()
    H.main_text("<article><p>text</p>" + part * (60_000 // len(part)), None)
    assert time.perf_counter() - begin < 2


def test_many_distinct_children_align_in_bounded_time():
    a, b = (H.fold(H.parse("".join(f'<div class="{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x{s}"><p>t</p></div>' for i in range(4000)))) for s in ("", "y"))
    begin = time.perf_counter()
    assert len(H.merge(a, b)[4]) == 8000
    assert time.perf_counter() - begin < 5
    assert len(H.merge(a, a)[4]) == 4000


def brute_lcs(x, y):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("table", [250_000, 4])
def test_alignment_against_brute_force(monkeypatch, table):
    monkeypatch.setattr(H, "_TABLE", table)
    rng = random.Random(3)
    for _ in range(200):
        x, y = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        found = H._matched(x, y)
        assert all(x[i] == y[j] for i, j in found) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(found, found[1:], strict=False))
        if table > 4:
            assert len(found) == brute_lcs(x, y)


def test_template_text(spark):
    """A line that is the same on all pages of a host is the template's, wherever it stands; an article is not, even if copied."""
    rows = [(i, "http://h.example/", f'<body><article><h1>Title {i}</h1><p>Own text {i} of it.</p><div class="box">Write to our paper</div></article></body>', "") for i in range(8)]
    rows += [(20 + i, "http://copies.example/", "<body><article><h1>One</h1><p>Same text.</p></article></body>", "") for i in range(8)]
    rows += [(40 + i, "http://few.example/", f'<body><article><p>Own {i}</p><div class="box">Same</div></article></body>', "") for i in range(3)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, ROWS).repartition(3)).collect()}
    assert got[3] == "Title 3\nOwn text 3 of it." and got[24] == "One\nSame text." and got[41] == "Own 1\nSame"

import itertools
import random

from tidemark.llm.html_extract import PRIOR, Tags, extract, min_cut

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><p>Site</p></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div>
<div class="cookie-notice"><p>We use cookies on this site.</p></div>
<article><h1>A &amp; B</h1><p><b>First  line&nbsp;here,<br>and on.<p>Second &lt;b&gt; one.</p><ul><li>Point one</li><li>Point two</li></ul></article>
<aside>Elsewhere</aside><section class="comments"><p>Reader says hi to all of you.</p></section><form><p>Your mail</p></form><footer>&copy; x</footer></body></html>"""


def test_article_alone_stays():
    assert extract(PAGE, PRIOR) == "A & B\nFirst line here, and on.\nSecond <b> one.\nPoint one\nPoint two"


def test_nothing_and_broken_markup():
    assert extract("", PRIOR) == ""
    assert extract("<", PRIOR) in ("", "<")
    assert isinstance(extract('<div class="x><p>a' * 50, PRIOR), str)


def test_cut_equals_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(1, 8)
        score = [rng.randrange(-9, 10) for _ in range(n)]
        edges = [(a, b, rng.randrange(1, 6)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(keep, score=score, edges=edges):
            return sum(abs(s) for s, k in zip(score, keep, strict=True) if (s > 0) != k and s) + sum(w for a, b, w in edges if keep[a] != keep[b])

        assert cost(min_cut(score, edges)) == min(map(cost, itertools.product((True, False), repeat=n)))


def test_unclosed_elements_dont_swallow_the_page():
    first, second = "First sentence of the story, long enough.", "Second sentence of it, which follows."
    for tag in ("button", "svg", "object", "title", "textarea", "iframe", "noscript"):
        got = extract(f"<article><p>{first}</p><{tag}>Go<p>{second}</p></article><footer>x</footer>", PRIOR)
        assert first in got and second in got, tag
    got = extract(f"<html><head><title>T</title><body><article><p>{first}</p><select><option>One<option>Two</select><p>{second}</p></article>", PRIOR)
    assert got == f"{first}\n{second}"
    assert extract(f"<article><p>{first}</p><svg><rect/></svg><p>{second} <button>Go</button> on</p></article>", PRIOR) == f"{first}\n{second} Go on"
    assert extract(f"<article><p>{first}</p><script>var x = '<p>no</p>'", PRIOR) == first


def test_names_on_text_dont_drop_it_but_those_of_containers_do():
    first, second = "First sentence of the story, long enough.", "Second sentence of it, which follows."
    assert extract(f'<article><p>{first}</p><p class="story-tags">{second}</p></article>', PRIOR) == f"{first}\n{second}"
    assert extract(f'<article><p>{first}</p><div class="ad"><p>{second}</p></div><section id="comments"><p>{second}</p></section></article>', PRIOR) == first


def test_pages_without_marks_are_told_apart_by_their_text():
    links = "".join(f'<li><a href="/{i}">Go {i}</a></li>' for i in range(12))
    prose = "".join(f"<p>This is the sentence number {i} of a longer story, and it says something.</p>" for i in range(6))
    got = extract(f"<body><ul>{links}</ul><div>{prose}</div><ul>{links}</ul></body>", PRIOR)
    assert got.count("\n") == 5 and "Go" not in got


def test_deep_and_long_pages_take_time_in_proportion():
    import time

    for page in ("<div>some text, here." * 50_000, "<div>" * 50_000 + "text", "<p>text, here" * 50_000, "</b>" * 200_000, "<ul><li>x" * 20_000, "<b>x" * 50_000):
        began = time.time()
        extract(page, PRIOR)
        assert time.time() - began < 6


def test_broken_markup_of_a_megabyte_takes_time_in_proportion():
    import time

    n = 1 << 20
    units = ("<a ", "<aaa", '<a b="c ', "<a", "<!", "<a b='c\" ", "<title ", "</title ", "<a<a\"", "<title>", "<script", "<a '\" \"", "<textarea>x</textarea ")
    for unit in units:
        for end in ("", ">", '">', "<a '>", ' "', "</p", "'x' \">"):
            page = unit * (n // len(unit)) + end
            began = time.time()
            extract(page, PRIOR)
            assert time.time() - began < 3, (unit, end)  # a second or less on a machine of its own
    assert extract("a" * n, PRIOR) in ("", "a" * n)


def test_tags_end_where_the_whole_pattern_says():
    import re

    pattern = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""")
    rng = random.Random(8)
    for _ in range(4000):
        page = "".join(rng.choice(["<", "<a", "</b", " ", "x", "/", ">", '"', "'", "=", "<c d='e'"]) for _ in range(rng.randrange(1, 25)))
        tags = Tags(page)
        for at in range(len(page)):
            m, found = pattern.match(page, at), tags.tag(at)
            assert (m and (m.start(1), m.end(1), m.end() - 1)) == found, (page, at)


def test_the_fit_leaves_markup_alone(spark):
    from tidemark.llm import html_extract

    rows = [(i, PAGE.replace("First", f"First{i}"), "t") for i in range(30)] + [(31, None, "t"), (32, "", "t"), (33, "<article>" + "<p>This is a sentence, and it is long enough.</p>" * 20_000, "t")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, text string")
    weights = html_extract.fit(pages)
    assert len(weights) == len(html_extract.FEATURES) and weights[1] < -1
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.html_text(pages, weights, keep=["page_id"]).collect()}
    assert got[3][0].startswith("A & B\nFirst3 line here") and got[31] == got[32] == ("", 0) and got[33][0].count("\n") == 19_999
    none = pages.limit(0)
    assert html_extract.html_text(none, html_extract.fit(none)).count() == 0

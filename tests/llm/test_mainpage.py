"""Main text of made-up pages, and of the given ones against their known layout."""

import html
import random
import re
import time

import pytest

from colloquy.llm import mainpage
from colloquy.llm.mainpage import extract, main_text

PROSE = "A sentence, with commas, that goes on for a while, long enough to count as prose of an article."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain words", "plain words"),
        ("<p>one<p>two &amp; three", "one\ntwo & three"),
        (f"<nav><a href=x>Home</a></nav><article><h1>T</h1><p>{PROSE}</p></article><footer>&copy; x</footer>", f"T\n{PROSE}"),
        (f"<body><header><h1>Site</h1></header><div class='ad'>{PROSE}</div><article><header><h1>Title</h1><p>by me</p></header><p>{PROSE}<br>more</p></article>", f"Title\n{PROSE} more"),
        (f"<div id='content'><p>{PROSE}</p><p>Short.</p></div><div class=sidebar><p>{PROSE}</p><p>{PROSE}</p></div>", f"{PROSE}\nShort."),
        (f"<article><p>{PROSE}</p><section class='comments'><p>{PROSE}</p></section></article><section id=comments><article class=comment><p>{PROSE} {PROSE}</p></article></section>", PROSE),
        (f"<main><p>a<script>var t='</p>';</script>b</p><style>p{{}}</style><form><p>{PROSE}</p></form><ul><li>{PROSE}<li>x</ul></main>", f"ab\n{PROSE}\nx"),
        ("<article><h1>Only a title</h1></article><p>Elsewhere, far away.</p>", "Only a title"),
        ("<article></article><nav><li><a>x</a></nav>", ""),
        (f"<article><p><b>{PROSE}<br><p>Next.</article><footer>foot", f"{PROSE}\nNext."),
        ("<article><p>a &lt;b&gt; &#233;&nbsp;&nbsp;c\n\t d 1 < 2 &am &amp</p></article>", "a <b> é c d 1 < 2 &am &"),
        (f"<article><p>{PROSE}</p><aside>x</aside><!-- <p>no</p> --><p>e<i>nd</i>.</p></article>", f"{PROSE}\nend."),
        (f"<div>{''.join(f'<p>{PROSE}</p>' for _ in range(10))}</div><article><h3>Teaser</h3><p>short one</p></article>", "\n".join([PROSE] * 10)),
        (f"<article><p>{PROSE} <a href='/hidden-gems'>gems</a> <a href='/a?id=comments'>link</a></p><p data-id='ads'>{PROSE}</p></article>", f"{PROSE} gems link\n{PROSE}"),
        (f"<article><h2 id='search-results'>Results</h2><section class='login-flow'><p>{PROSE}</p></section></article>", f"Results\n{PROSE}"),
        (f"<article><pre><span class='comment'># note</span> x = 1</pre><p>{PROSE}</p><div class='ad-slot'><p>{PROSE}</p></div></article>", f"# note x = 1\n{PROSE}"),
        (f"<article><section><h2>A</h2><p>{PROSE}</p></section><section><h2>B</h2><p>{PROSE}</p></section></article>", f"A\n{PROSE}\nB\n{PROSE}"),
        (f"<main><div><h1>T</h1><div><p>{PROSE}</p><p>{PROSE}</p></div></div></main>", f"T\n{PROSE}\n{PROSE}"),
        (f'<div class="cookie-notice"><p>{PROSE}</p></div><div class="post has-sidebar"><p title="a > b">{PROSE}</p></div>', PROSE),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def expected(page):
    """The text of the given pages' one article, by its known simple markup."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(p for p in parts if p)


def test_query(spark):
    from colloquy.llm.queries import op6_main_text

    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = op6_main_text(spark, d).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == expected(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_frames(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "<p>a</p>" * 20_000, None)], "page_id long, html string, text string")
    got = extract(df).collect()
    assert sorted(len(r.text) for r in got) == [0, 0, 39_999]
    assert extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def plain_best(page):
    """The best container of a well-formed page of div, section, p and a, scored by a plain recursion over all pairs
    of a paragraph and an ancestor."""
    from xml.etree import ElementTree

    root = ElementTree.fromstring(page)
    up = {c: x for x in root.iter() for c in x}
    text = lambda x: "".join(x.itertext())
    size = lambda x: sum(len(t.strip()) for t in x.itertext())
    links = lambda x: sum(size(a) for a in x.iter("a"))
    score = {}
    for p in root.iter():
        own = len((p.text or "").strip()) + sum(len((c.tail or "").strip()) for c in p)
        if not size(p) or not (p.tag == "p" or (p.tag in ("div", "section") and own >= 25)):
            continue
        points = (1 + text(p).count(",") + min(size(p) / 100, 3)) * (1 - links(p) / size(p))
        x = p if p.tag != "p" else up.get(p)
        for share in (1, 2, 3):
            if x is not None:
                score[x] = score.get(x, 0) + points / share
                x = up.get(x)
    final = {x: (s + (3 if x.tag in ("div", "section") else 0)) * (1 - links(x) / size(x)) for x, s in score.items()}
    return [x.get("n") for x in sorted(final, key=lambda x: -final[x])][:1], {x.get("n"): round(f, 6) for x, f in final.items()}


def random_page(rng):
    count = iter(range(10_000))

    def part(depth):
        tag = rng.choice(["p", "p", "div", "section"]) if depth < 5 else "p"
        n = next(count)
        if tag == "p":
            said = " ".join(rng.choice(["word", "other,", "thing", "<a>link text</a>"]) for _ in range(rng.randint(1, 60)))
            return f'<p n="{n}">{said}</p>'
        return f'<{tag} n="{n}">' + "".join(part(depth + 1) for _ in range(rng.randint(1, 5))) + f"</{tag}>"

    return '<html n="root">' + "".join(part(0) for _ in range(rng.randint(1, 5))) + "</html>"


def test_scores_against_a_plain_recursion():
    rng = random.Random(12)
    for _ in range(150):
        page = random_page(rng)
        root = mainpage.tree(page)
        names = {}
        for x, n in zip([x for x in mainpage._walk(root.children[0]) if x.tag not in ("a",)], re.findall(r' n="(\w+)"', page)):
            names[id(x)] = n
        measure = mainpage._measure(root.children[0])
        found = mainpage.scored(root.children[0], measure)
        link = lambda x: 1 - measure[id(x)][1] / measure[id(x)][0]
        final = {names[id(x)]: round((x.score + mainpage.START.get(x.tag, 0)) * link(x), 6) for x in found}
        best, want = plain_best(page)
        assert final == want
        assert final[best[0]] == max(final.values())


def test_work_is_linear_in_nesting():
    began = time.perf_counter()
    for page in ("<span><h1>" * 10_000, "<div>" * 50_000 + PROSE, "<header>" * 20_000 + "<h1>x", "<li>" * 30_000, "<ul><li>x" * 10_000, "<p><b>" * 20_000 + "</i>" * 20_000):
        main_text(page)
    assert time.perf_counter() - began < 6


def test_elements_that_close_themselves_and_related_articles():
    assert main_text("<article><p>A<svg/> tail</p><p>B<math /> C</p></article>") == "A tail\nB C"
    assert main_text("<article><p>A<svg><path/></svg> tail</p><p>B</p><script/>x</script><p>C</p></article>") == "A tail\nB\nC"
    inner = '<article class="related"><p>Another story, about something else, in a few words.</p></article>'
    assert main_text(f"<article><p>The story, told at length, with commas.</p>{inner}<p>Its end.</p></article>") == "The story, told at length, with commas.\nIts end."
    assert main_text('<article class="related"><p>The only story, told here.</p></article>') == "The only story, told here."

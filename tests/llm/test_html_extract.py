import random
import re
from collections import Counter, defaultdict

import pytest

from tesserax.llm import html_extract
from tesserax.llm.html_extract import FEW_WORDS, MIN_PAGES, SMALL_SHARE, main_text, parse


def words(page):
    return " ".join(b[1] for b in parse(page)[0] if b[1])


CASES = {
    "": "",
    "plain  text": "plain text",
    "<p>a<p>b<br>c": "a b c",
    "<p>one <b>bo</b>ld &amp; &eacute;&#233; &copy\n\n x</p>": "one bold & éé © x",
    "<div>a</div>b<div>c</div>": "a b c",
    "<script>var t='</p>';</script><style>p{}</style><p>x": "x",
    "<nav>menu</nav><article><h1>T</h1><p>body</p></article><footer>f</footer>": "T body",
    "<html><head><title>t</title></head><body><header>h</header><main><p>m</main><aside>s": "m",
    "<article><p>keep</p><div class='ad'>x</div><div id=comments>c</div><form>f</form><p>too</article><div>out</div>": "keep too",
    "<article><header><h1>Title</h1></header><p>t</p><footer>by</footer></article>": "Title t",
    "<div class='content has-sidebar'><p>in</p><div class='sidebar'>out</div></div>": "in",
    "<div class='page-ad'><article>kept</article> gone</div>": "kept",
    "<p>a</p><div hidden>b</div><div style='display: none'>c</div><p>d": "a d",
    "<p>1 < 2 and a<b</p>": "1 < 2 and a",
    "<!-- c --><p>a<!-- <p>b</p> -->c": "ac",
    '<a title="a > b" href=\'x\'>link</a>': "link",
    "<p>x &am": "x &am",
    "<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>": "a b c d",
    "<p><b>open<br><p>next</p>": "open next",
    "<div role=banner>b</div><div role='main'>m</div>z": "m",
    "<article>a<br></article></nav></div><p>": "a",
    "<ARTICLE>Up<SCRIPT>x</SCRIPT></ARTICLE>": "Up",
    "<p>a&nbsp;&nbsp;b c</p>": "a b c",
    "<div class='commentsection'>c</div><aside>s</aside><p class=commentary>kept</p><div class='cookiebar'>n</div>": "kept",
    "<main><h2>H</h2><p>a</p><section class='related-posts'><article class=card>r</article></section></main><article class='comment'>c</article>": "H a",
    "<main><p>the long text of the main part</p><article>short</article></main>": "the long text of the main part short",
    "<main><p>intro</p><article>the long text of the article</article></main>": "the long text of the article",
    "<div class=readerComments>c</div><div class='cookieNotice'>n</div>t": "t",
}


@pytest.mark.parametrize("page", CASES)
def test_roles(page):
    assert words(page) == CASES[page]


def test_long_and_deep_pages():
    assert words("<div>" * 20_000 + "x") == "x"
    assert len(words("<p>word " * 100_000)) == 5 * 100_000 - 1
    assert words("<a b='" * 30_000) is not None
    assert words("<" * 100_000 + " x").endswith("x")


def test_site_templates_go_and_copies_stay(spark):
    rows = []
    for i in range(30):
        rows.append((i, f"http://Site.example/{i}", f"<div class=c1>Our shop since 1999</div><div><p>unique {i} text</p></div><div><p>Call us</p></div>"))
    rows += [(100 + i, f"http://copies.example/{i}", "<div><p>same page</p></div>") for i in range(30)]
    rows += [(200 + i, f"http://arts.example/{i}", f"<article><p>shared passage</p><div>Follow us</div><p>own {i}</p></article>") for i in range(30)]
    rows += [(300, None, "<p>no url"), (301, "http://site.example/", None), (None, "x", "")]
    df = spark.createDataFrame([(h, u, i, 5) for i, u, h in rows], "html string, url string, page_id long, host int")
    got = {r.page_id: r for r in main_text(spark, df).collect()}
    assert len(got) == len(rows)
    assert all(got[i].text == f"unique {i} text" for i in range(30))
    assert all(got[100 + i].text == "same page" for i in range(30))
    assert all(got[200 + i].text == f"shared passage own {i}" for i in range(30))
    assert (got[300].text, got[301].text, got[301].n_chars, got[None].text) == ("no url", "", 0, "")
    assert main_text(spark, df.limit(0)).count() == 0


def test_rotating_boilerplate_of_a_large_host_goes(spark):
    # Each advert is on 20 of 200 pages: a tenth of the host.
    rows = [(i, f"http://big.example/{i}", f"<div><p>Deal {i % 10} of the week</p></div><div><p>own {i} words</p></div>") for i in range(200)]
    got = main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(i, f"own {i} words") for i in range(200)]


def brute(rows):
    """The whole operator by plain counting over (page_id, host, html)."""
    read = [(i, host, *parse(page or "")) for i, host, page in rows]
    once = {(host, body): (subs, kinds, words) for _, host, _, subs, kinds, words, body in read}
    bodies = Counter(host for host, _ in once)
    kind, path, content = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for (host, _), (subs, kinds, words) in once.items():
        for s, p, n, core, within, w, links, heads in kinds:
            kind[host, s, p].update(pages=1, n=n, core=core, within=within, words=w, links=links, heads=heads, all=words)
            path[host, p].update(n=n, core=core, within=within)
        for c, s, inner, h1 in subs:
            content[host, s, c].update(pages=1, h1=int(h1), outer=int(not inner))
    many = lambda host, n: n >= MIN_PAGES and n * n >= bodies[host]
    gone, apart, free = set(), set(), set()
    for (host, s, p), k in kind.items():
        q = path[host, p]
        beside = all(2 * (x["core"] + x["within"]) < x["n"] for x in (k, q))
        if all(2 * (x["core"] + x["within"]) <= x["n"] for x in (k, q)):
            apart.add((host, s))
        if all(2 * x["core"] <= x["n"] for x in (k, q)):
            free.add((host, s))
        menu = 2 * k["links"] >= k["words"] and 2 * k["words"] <= k["all"]
        short = not k["heads"] and k["words"] <= FEW_WORDS * k["pages"] and k["words"] <= SMALL_SHARE * k["all"]
        if beside and many(host, k["pages"]) and (menu or short):
            gone.add((host, s))
    for (host, s, c), k in content.items():
        fits = (host, s) in apart or not k["outer"] and (host, s) in free
        if fits and many(host, k["pages"]) and (not k["h1"] or 2 * k["pages"] >= bodies[host]):
            gone.add((host, c))
    return sorted((i, " ".join(role for _, role, c, s in blocks if role and not any((host, h) in gone for h in (*c, *s)))) for i, host, blocks, *_ in read)


def site(seed, pages, hosts=2):
    """Pages with menus, rotating adverts and unlike footers around articles of many lengths."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    adverts, copies = [words(5, 9) for _ in range(5)], [[words(20, 60)] for _ in range(3)] + [[word()]]
    out = []
    for i in range(pages):
        paragraphs = rng.choice(copies) if rng.random() < 0.3 else [words(1, 80) for _ in range(rng.randint(1, 6))]
        title = paragraphs[0][:20].strip()
        menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in words(4, 7).split())
        text = "".join(f"<p>{p}" if rng.random() < 0.5 else f"<p>{p}</p>" for p in paragraphs)
        cells = [word() + str(i), word()] if rng.random() < 0.1 else []
        table = f"<table><tr><td>{'<td>'.join(cells)}</table>" if cells else ""
        page = f"<html><body><nav><ul>{menu}</ul></nav><aside class=box>{rng.choice(adverts)}</aside><article><h1>{title}</h1>{text}{table}</article><footer>by {words(3, 15)}</footer>"
        out.append((i, f"h{rng.randrange(hosts)}.example", page, " ".join([title, *paragraphs, *cells])))
    return out


@pytest.mark.parametrize("rename", [False, True])
def test_templates_go_by_their_counts_whatever_their_tags(spark, rename):
    rows = site(3, 160)
    if rename:
        rows = [(i, h, re.sub(r"(</?)(nav|aside|article|footer)\b(?: class=box)?", r"\1div", page), text) for i, h, page, text in rows]
    df = spark.createDataFrame([(i, f"http://{h}/{i}", page) for i, h, page, _ in rows], "page_id long, url string, html string")
    got = main_text(spark, df).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(i, text) for i, _, _, text in rows] == brute([r[:3] for r in rows])
    assert all(r.by_content + r.by_skeleton > 0 and r.by_roles == 0 for r in got)


@pytest.mark.parametrize("limit", [html_extract.BROADCAST_HASHES, 0])
def test_counting_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(html_extract, "BROADCAST_HASHES", limit)
    rng = random.Random(9)
    rows = []
    for i in range(300):
        parts = [f"<{t}>{rng.choice(('one two', 'three', 'a b c d e', f'own {rng.randrange(60)} words here'))}</{t}>" for t in rng.choices(["div", "p", "section", "ul", "h2", "span", "nav"], k=rng.randint(0, 6))]
        if rng.random() < 0.5:
            parts = ["<div class='c%d'>" % rng.randrange(3), *parts, "</div>", rng.choice(("", "<div><a href=x>more</a></div>"))]
        rows.append((i, f"h{rng.randrange(4)}.example", "".join(parts)))
    rows += [(i, h, page) for i, h, page in rows[:40]] + [(500, "h1.example", None), (501, "", "<p>x</p>")]
    df = spark.createDataFrame([(i, f"http://{h}/{i}" if h else None, page) for i, h, page in rows], "page_id long, url string, html string")
    assert sorted((r.page_id, r.text) for r in main_text(spark, df).collect()) == brute(rows)

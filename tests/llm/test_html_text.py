import os
import re
import sys
from html import unescape

sys.path.insert(0, os.path.dirname(__file__))
from llm_fixtures import clashing, same

from tavola.llm import html_text as H

TREE = H.train()
LONG = "word " * 40


def test_articles_of_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in H.extract(clashing(pages, "text", "n_chars")).collect()}
    for page in pages.collect():
        article = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert got[page.page_id].text == want and got[page.page_id].n_chars == len(want) and got[page.page_id].url == page.url


def test_boilerplate_of_other_layouts():
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>'
        f'<div class="sidebar"><p>{LONG}</p></div><main><h1>Title</h1><p>Short.</p><p>One {LONG}</p><form><label>Name</label></form>'
        f'<section id="comments"><p>Nice post {LONG}</p></section><p class="advert">Buy {LONG}</p></main><footer>c</footer><script>var x="</p>"</script></body></html>'
    )
    assert H.main_text(page, TREE) == f"Title\nShort.\nOne {LONG}".strip()


def test_plain_layout_without_containers():
    page = f"<body><ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul><h1>A title</h1><p>{LONG}</p><p>Sh.</p><p>{LONG}</p><ul><li><a href=x>l</a></li></ul>"
    assert H.main_text(page, TREE) == f"A title\n{LONG.strip()}\nSh.\n{LONG.strip()}"


def test_markup_white_space_and_references():
    page = "<article><p>a<b>b</b>\n\t c &lt;x&gt;&amp;&#233; d<!-- <p>no</p> --><p>e<br>f<p title='>'>g</article>"
    assert H.main_text(page, TREE) == "ab c <x>&é d\ne f\ng"


def test_broken_and_empty_pages(spark):
    broken = ["", None, "<", "<article>x", "<script>x", "<!-- x", "<p", "</p></p>", "<article><div></span></article>" * 200, "<a <b>c", '<p a="x>y']
    for html in broken:
        H.main_text(html, TREE)
    rows = [(1, "u", None), (None, None, ""), (2, None, "<article>x &#x0; y</article>"), (2, None, "<article>x</article>")]
    got = H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert same([(r.page_id, r.url) for r in got], [r[:2] for r in rows])
    assert {r.text for r in got if r.page_id != 2} == {""}
    assert H.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_tree_fits_its_table():
    rows = [list(map(float, x.split())) for x in H.LABELLED.strip().splitlines()]
    for r in rows:
        features = [v / 100 if i in (1, 3, 5) else v for i, v in enumerate(r[:-1])]
        assert H.classify(TREE, tuple(features)) == r[-1]


def test_elements_left_out_end_where_they_end():
    article = f"<article><p>One {LONG}</p><p>Two {LONG}</p></article>"
    whole = H.main_text(article, TREE)
    assert whole.startswith("One") and "Two" in whole
    for name in sorted(H.APART):
        assert H.main_text(f"<body><div><{name} class='i'>left out</{name}></div>{article}</body>", TREE) == whole
        assert H.main_text(f"<body><div><{name} class='i'></div>{article}</body>", TREE) == whole, name
        assert H.main_text(f"<body><{name}>{article}</body>", TREE) == whole, name
        assert H.main_text(f"<body><div><{name}></div>{article}<{name}>left out</{name}></body>", TREE) == whole, name
        assert H.main_text(f"<article><p>One <{name}><b>left</b> out<div>x</div></{name}>{LONG}</p><p>Two {LONG}</p></article>", TREE) == whole or name in H.FOREIGN
    for name in H.FOREIGN:
        assert H.main_text(f'<{name} class="i"/>{article}<{name}><path d=""/><title>T</title></{name}>', TREE) == whole
        assert H.main_text(f"<{name}><g>left out{article.replace('<article>', '<div><article>')}</div>", TREE) == whole
        assert H.main_text(f"<article><p>One <{name}><title/><style/><foreignObject><div>out</div></foreignObject></{name}>{LONG}</p><p>Two {LONG}</p></article>", TREE) == whole
    for name in H.RAW:
        assert H.main_text(f"{article}<{name}>x {article}", TREE) == whole
        assert H.main_text(f"<{name}>x <p></{name} >{article}", TREE) == whole


def test_many_unclosed_elements():
    for name in sorted(H.APART):
        H.main_text(f"a<{name}>" * 20000, TREE)


def test_whole_names_make_noise():
    whole = f"Title\nOne {LONG}\nTwo {LONG}".replace(" \n", "\n").strip()
    inner = f"<h1>Title</h1><p>One {LONG}</p><p>Two {LONG}</p>"
    assert H.main_text(f"<div>{inner}</div>", TREE) == whole
    for attrs in ("class='overflow-hidden'", "class='has-sidebar x'", "class=no-sidebar", "id='with-banner'", "class='post-share-enabled'", "data-state='hidden'", 'data-id="promo"', "data-class='ad' data-hidden", "title='a class=ad id=nav'"):
        assert H.main_text(f"<div {attrs}>{inner}</div>", TREE) == whole, attrs
    for attrs in ("class='x sidebar'", "CLASS=advert", "id='cookie-notice'", "id=cookieBanner", "class='share_buttons'", "hidden", "aria-hidden=true", "style='x:y; display : none'", "role=navigation"):
        assert H.main_text(f"<div {attrs}>{inner}</div>", TREE) == "", attrs


def test_named_containers_of_main_and_article():
    article = f"<p>One {LONG}</p><p>Two {LONG}</p>"
    whole = f"One {LONG}\nTwo {LONG}".replace(" \n", "\n").strip()
    for tag in ("main", "article"):
        for outer in ("<div class='widget'>", "<form id=f>", "<div id='overlay'><section class=modal>"):
            assert H.main_text(f"{outer}<{tag}>{article}</{tag}></div>", TREE) == whole
        assert H.main_text(f"<div hidden><{tag}>{article}</{tag}></div>", TREE) == ""
    comments = f"<section id=comments><article><p>Nice {LONG}</p></article></section>"
    assert H.main_text(f"<article>{article}</article>{comments}", TREE) == whole


def test_long_text_of_few_links_overrules_names():
    long, links = "word " * 200, "<a href=x>" + "word " * 200 + "</a>"
    assert H.main_text(f"<div class='overlay'><p>{long}</p></div>", TREE) == long.strip()
    three = "word " * 90
    assert (three.strip() + "\n" + three.strip()) in H.main_text(f"<div class='overlay'><p>{three}</p><p>{three}</p><p>{three}</p><p>{three}</p></div>", TREE)
    assert H.main_text(f"<div class='overlay'><p>{links}</p></div>", TREE) == ""
    assert H.main_text(f"<div hidden><p>{long}</p></div><footer><p>{long}</p></footer>", TREE) == ""


def test_short_noise_next_to_long_text_stays_out():
    long = "word " * 160
    article = f"<article><p>{long}</p></article>"
    for noise in ("<nav>Menu of pages</nav>", "<div class=sidebar>Menu of pages</div>", "<div hidden>Menu of pages</div>", f"<footer>{LONG}</footer>", f"<div id=promo>{LONG}</div>"):
        assert H.main_text(noise + article, TREE) == H.main_text(article + noise, TREE) == long.strip(), noise


def test_long_noise_beside_the_text_is_dropped():
    plain = f"<div><p>One {LONG}</p><p>Two {LONG}</p></div>"
    want = f"One {LONG}\nTwo {LONG}".replace(" \n", "\n").strip()
    short = "<article><p>Thirty words " + "and more " * 14 + "</p></article>"
    for n in (60, 90, 120, 200, 500):
        text = "<p>" + "noise " * n + "</p>"
        for noise in ("<div id=comments>{}</div>", "<div class=comment>{}</div>", "<div class='advert'>{}</div>", "<div class='cookie-notice'>{}</div>", "<div class=notice>{}</div>", "<div class=sidebar>{}</div>", "<div class=widget>{}</div>"):
            noise = noise.format(text)
            for page in (f"<article>{plain}</article>", plain, f"<main>{plain}</main>"):
                assert H.main_text(page + noise, TREE) == H.main_text(noise + page, TREE) == want, (n, noise[:30])
            assert "noise" not in H.main_text(noise + short, TREE)
    inside = "<div id='comments'><article><p>" + "reader " * 30 + "</p></article></div>"
    assert H.main_text(inside + plain, TREE) == H.main_text(plain + inside, TREE) == want
    teaser = "<div class=sidebar><article><p>" + "teaser " * 30 + "</p></article></div>"
    assert H.main_text(teaser + plain, TREE) == want


def test_a_lone_wrapper_is_kept():
    long = "word " * 300
    for name in ("overlay", "widget", "sidebar", "promo"):
        page = f"<nav><a href=x>Menu</a></nav><div class={name}><h1>Title</h1><p>{long}</p></div><p>Printed by us.</p><footer>{LONG}</footer>"
        assert long.strip() in H.main_text(page, TREE)


def test_stray_quotes_end_with_their_tag():
    four = ["First it's", "Two", "Three's", "Four"]
    page = f"<article><p>{four[0]} {LONG}</p><p title=x'>{four[1]} {LONG}</p><p>{four[2]} {LONG}</p><p class=\"a\" b'>{four[3]} {LONG}</p></article>"
    assert H.main_text(page, TREE) == "\n".join(f"{x} {LONG}".strip() for x in four)
    assert H.main_text(f"<article><p title='a > b' x = \"c > d\">One {LONG}</p></article>", TREE) == f"One {LONG}".strip()


def test_time_does_not_grow_with_the_square():
    import time

    for page in ("<b><i>" * 32000 + "</u>" * 32000, "<div><b>" * 32000 + "</b></i></div>" * 32000, "<svg><g>" * 32000 + "<p>", "<noscript>" * 64000 + "</noscript>" * 64000):
        begin = time.process_time()
        H.blocks(page)
        assert time.process_time() - begin < 2


def walk(node, kind=(0, False), heading=False):
    """Blocks of a tree of (tag, attributes, children) and texts, as (text, kind, heading)."""
    runs = []

    def go(node, kind, heading):
        if isinstance(node, str):
            runs.append((node, kind, heading))
            return
        tag, names, children = node
        inline = tag in H.INLINE
        if tag in ("aside", "nav", "footer"):
            kind = (2, kind[1])
        elif kind[0] != 2 and "comments" in names:
            kind = (2, kind[1])
        elif kind[0] != 2 and "sidebar" in names:
            kind = (1, kind[1])
        heading = heading or tag == "h2"
        if not inline:
            runs.append(None)
        for c in children:
            go(c, kind, heading)
        if not inline:
            runs.append(None)

    go(node, kind, heading)
    out, current = [], []
    for r in [*runs, None]:
        if r is None or current and r[1:] != current[-1][1:]:
            text = " ".join("".join(t for t, *_ in current).split())
            if text:
                out.append((text, current[0][1][0], current[0][2]))
            current = []
        if r is not None:
            current.append(r)
    return out


def test_blocks_against_a_tree_walk():
    import random

    rnd = random.Random(8)

    def node(depth):
        if depth == 0 or rnd.random() < 0.3:
            return rnd.choice(["one two ", "x", " y ", "three four five ", "\n"])
        tag = rnd.choice(["div", "section", "ul", "b", "i", "span", "h2", "aside", "blockquote"])
        children = [node(depth - 1) for _ in range(rnd.randrange(4))]
        if tag in H.INLINE:
            children = [c for c in children if isinstance(c, str) or c[0] in H.INLINE]
        return tag, rnd.choice(["", "", "sidebar", "comments x"]) if tag not in H.INLINE else "", children

    def html(n):
        return n if isinstance(n, str) else f"<{n[0]}" + (f' class="{n[1]}"' if n[1] else "") + ">" + "".join(map(html, n[2])) + f"</{n[0]}>"

    for _ in range(500):
        tree = ("body", "", [node(6) for _ in range(3)])
        got = H.blocks(html(tree))
        want = walk(tree)
        assert [(b[0], min(b[3], 1), b[5]) for b in got] == [(t, min(k, 1), h) for t, k, h in want]

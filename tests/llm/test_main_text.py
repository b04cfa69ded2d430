"""Main text of pages: hand-made pages, the given pages by their markup, odd rows."""

import html as markup
import re
import time

import pytest

from strandline.llm import main_text, queries

SF = "/root/testdata/sf0.001"
LONG = "It was the best of times and the worst of times, and there is more of that in the book on the table."
ALSO = "Le chat est sur la table et le chien est dans la maison avec les enfants, mais pas pour le moment."
LINKS = "<ul>" + "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(5)) + "</ul>"

PAGES = {
    "layout": (
        f"<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1>{LINKS}</header><div id='sidebar'><p>{ALSO}</p></div>"
        f"<main><h1>Title</h1><p>{LONG}</p><div class='advert'><p>{LONG}</p></div><p>Short.</p><p>{ALSO}</p></main>"
        f"<section id='comments'><article class='comment'><p>{LONG}</p></article></section><footer><p>{LONG}</p></footer></body></html>",
        f"Title\n{LONG}\nShort.\n{ALSO}",
    ),
    "no elements to go by": (f"<table><tr><td>{LINKS}</td><td><b>Title</b><p>{LONG}<p>Short one.<p>{ALSO}</td></tr></table><div>© 2020 Company, all rights</div>", f"Title\n{LONG}\nShort one.\n{ALSO}"),
    "lists and references": ("<article><p>Fish &amp; chips&nbsp;&#8212; a\n\n tab\t&lt;b&gt;</p><ol><li>One</li><li>Two <a href=x>l</a> and more</li></ol></article>", "Fish & chips — a tab <b>\nOne\nTwo l and more"),
    "scripts": (f"<article><p>{LONG}</p><script>document.write('<p>no</p>')</script><noscript>Turn it on</noscript><!-- <p>{LONG}</p> --><p>End.</p></article>", f"{LONG}\nEnd."),
    "cut in a tag": (f"<article><p>{LONG}</p><p>Open <a href='x", f"{LONG}\nOpen"),
    "cut in a comment": (f"<article><p>{LONG}</p><!-- never ended <p>x</p>", LONG),
    "quoted bracket": (f"<article><p title='a > b'>{LONG}</p></article>", LONG),
    "page in a form": (f"<form id=aspnet><div class='menu'>Home</div><main><p>{LONG}</p></main><input value=x></form>", LONG),
    "wrapper with a telling name": (f"<div class='page sidebar-left'><div class='sidebar'>{LINKS}</div><p>{LONG}</p></div>", LONG),
    "related articles": (f"<article><p>{LONG}</p></article><div class='related'><article><p>{ALSO}</p></article></div>", LONG),
    "notices": (f"<div class='cookie-notice'>{LONG}</div><div role='dialog'><p>{LONG}</p></div><article class='post'><header class='entry-header'><h1>T</h1></header><p>{LONG}</p></article>", f"T\n{LONG}"),
    "form in the article": (f"<article><p>{LONG}</p><form><label>Mail</label><input><button>Send</button></form><p>{ALSO}</p></article>", f"{LONG}\n{ALSO}"),
    "unclosed paragraphs": (f"<article><p>{LONG}<br><p>{ALSO}<h2>Head</h2>tail</article>", f"{LONG}\n{ALSO}\nHead\ntail"),
    "stray ends": (f"</div></p><article></span><p>{LONG}</b></p></article></body>", LONG),
    "one short block": ("<p>Hello</p>", "Hello"),
    "short article beside menus": (f"<nav>{LINKS}</nav><article><h1>De.</h1></article><footer>x</footer>", "De."),
    "only chrome": (f"<nav>{LINKS}</nav><div class=ad>{LONG}</div><article></article><footer>{LONG}</footer>", ""),
    "plain text": ("just words", "just words"),
    "no known stop words": (f"<div>{LINKS}</div><p>{'abra kadabra simsala bim ' * 12}</p>", ("abra kadabra simsala bim " * 12).strip()),
    "links without a menu": (f"<div>{LINKS}</div><p>{LONG}</p><div><a href=a>Next page of these</a> | <a href=b>Last</a></div>", LONG),
    "upper case": (f"<ARTICLE><P>{LONG}</P><NAV>{LINKS}</NAV></ARTICLE>", LONG),
    "hidden": (f"<article><p>{LONG}</p><div style='display: none'>{ALSO}</div><p hidden>x</p></article>", LONG),
    "two breaks": (f"<article>{LONG}<br><br>{ALSO}<br>more</article>", f"{LONG}\n{ALSO} more"),
    "settings in class names": (f"<body class='has-sidebar'><div class='wrap no-ads with-sidebar'><article class='post comments-open'><p>{LONG}</p></article><div class='comments'><p>{ALSO}</p></div></div></body>", LONG),
    "advert in a paragraph": (f"<article><p>{LONG} <span class='ad'>Buy it now</span></p><aside>{ALSO}</aside><p class='promo'>{ALSO}<p>End.</article>", f"{LONG}\nEnd."),
    "camel case names": (f"<div id='mainContent'><h2>Head</h2><p>{LONG}</p></div><div id='rightSideBar'>{ALSO}</div><div class='userComments'>{ALSO}</div>", f"Head\n{LONG}"),
    "empty": ("", ""),
    "white": (" \n ", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_hand_made(name):
    page, want = PAGES[name]
    assert main_text.main_text(page) == want, main_text.blocks(page)


def test_reasons():
    found = {b.text: (b.label, b.why) for b in main_text.blocks(PAGES["layout"][0])}
    assert found[LONG] == ("boilerplate", "element") and found["Short."] == ("text", "neighbour") and found["Title"] == ("text", "neighbour")
    assert main_text.blocks(PAGES["links without a menu"][0])[0].why == "links"


def test_query_by_markup(spark):
    """In the given pages the article element holds exactly the text."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    want = {}
    for p in pages:
        inside = p.html.split("<article>")[1].split("</article>")[0]
        lines = (" ".join(markup.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inside))
        text = "\n".join(x for x in lines if x)
        want[p.page_id] = (p.url, text, len(text))
    found = queries.op13_main_text(spark, SF)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in found.collect()} == want and len(want) == len(pages)


def test_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>a 😀</p>"), (2, "v", ""), (3, "w", "<p>" * 50_000 + "x" + "<div>" * 50_000), (4, "x", f"<article>{('<p>' + LONG) * 20_000}")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "1 AS n_chars")
    out = sorted(main_text.extract(df).collect(), key=lambda r: (r.page_id or 0, r.url or ""))
    assert [(r.page_id, r.n_chars) for r in out] == [(None, 3), (1, 0), (1, 0), (2, 0), (3, 1), (4, 20_000 * (len(LONG) + 1) - 1)]
    assert main_text.extract(df.limit(0)).collect() == []
    labelled = spark.createDataFrame([(PAGES["hidden"][0],), (None,)], "html string").select(main_text.labelled_blocks(main_text.F.col("html")).alias("b")).collect()
    assert [len(r.b) for r in labelled] == [3, 0]


@pytest.mark.parametrize("page", ["<a '" * 20_000, "<" * 100_000, "<!--" * 20_000, "<div>" * 20_000 + "x</p>" * 20_000, "<b><p>" * 20_000, "<script>" * 20_000, "<ul><li>" * 10_000 + "</li>x" * 10_000, "<a href=x" * 20_000 + ">"])
def test_hostile_pages_end(page):
    began = time.perf_counter()
    main_text.main_text(page)
    assert time.perf_counter() - began < 5

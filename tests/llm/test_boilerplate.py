"""Hand-made pages with their main texts."""

from gleanery.llm.boilerplate import extract, main_text

PROSE = "It was the best of the times and it was the worst of them, and for all that is in the books they had not been there when it was to be read by the people of the town, which is as it should be for them."


def test_marked_article():
    page = """<html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>"</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>
      <div class="cookie-notice">We use cookies &amp; more</div><aside>Side</aside><article><header><h1>A &lt;b&gt; title</h1></header><p>One<br>two &eacute;&#233;&nbsp;x<p class='ad'>Buy
      <p><b>Three</b> <i>four</i>.</p><div id="comments"><article>I disagree</article></div><form>mail <input></form>short</article><footer>&copy; us</footer><!-- <p>never</p> --></body></html>"""
    assert main_text(page) == "A <b> title\nOne two éé x\nThree four.\nshort"


def test_headers_and_roles():
    page = """<div class="page-header"><h1>Shop</h1></div><div role="main"><div class="post-header"><h1>Title</h1></div><p>Body</p><div class=relatedPosts>More</div>
      <div class="shadow download">kept</div></div><div role=contentinfo>imprint</div>"""
    assert main_text(page) == "Title\nBody\nkept"


def test_decided_by_text():
    menu = "<div>" + "".join(f"<a href='/{i}'>entry number {i} of it</a> " for i in range(9)) + "</div>"
    page = f"<body>{menu}<h2>Heading</h2><p>{PROSE}</p><p>Brief.</p><p>{PROSE}</p><p>Tail.</p>{menu}<p>Imprint</p></body>"
    assert main_text(page) == f"Heading\n{PROSE}\nBrief.\n{PROSE}"


TEASER = "<article><h3><a href=/{0}>Another story with number {0}</a></h3><p>What is in the story and who has it.</p><p><a href=/{0}>Read more</a></p></article>"


def test_articles_that_are_teasers():
    cards = "".join(TEASER.format(i) for i in range(3))
    for prose in (PROSE, PROSE * 2):  # middling and long paragraphs
        want = f"Heading\n{prose}\nBrief.\n{prose}"
        body = f"<div><h1>Heading</h1><p>{prose}</p><p>Brief.</p><p>{prose}</p></div>"
        check_teasers(body, cards, want)


def check_teasers(body, cards, want):
    assert main_text(f"<body>{body}<section>{cards}</section></body>") == want
    assert main_text(f"<body>{cards}{body}{cards}</body>") == want
    assert main_text(f"<body><main>{body}{cards}</main></body>") == want


def test_article_is_a_prior():
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>entry number {i} of it</a></li>" for i in range(9)) + "</ul>"
    odd = "Quux blorf zint, " * 10
    page = f"<article><h1>Title</h1><p>Brief.</p>{menu}<p>{PROSE}</p><p>{odd}</p><h2>Links</h2>{menu}</article><p>{odd}</p><p>Imprint</p>"
    assert main_text(page) == f"Title\nBrief.\n{PROSE}\n{odd.strip()}"
    assert main_text(f"<p>Site</p><article><h1>Title</h1><p>{odd}</p></article><p>Imprint</p>") == f"Title\n{odd.strip()}"
    assert main_text(f"<article><p>{PROSE}</p></article><div><p>{PROSE} Again.</p></div>") == f"{PROSE}\n{PROSE} Again."


def test_head_without_end_tag():
    for head in ("<head><title>x</title>", "<HEAD lang=en><meta charset=utf-8><style>p{}</style><script>var a='<p>no</p>'</script><title>x</title><link href=y>"):
        for end in ("<body>", "</head><body>", ""):
            assert main_text(f"<html>{head}{end}<article><p>{PROSE}</p></article></body></html>") == PROSE
    assert main_text(f"<head><title>x</title><p>{PROSE}") == PROSE


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<p>") == main_text("<!-- <article>x") == main_text("<script>x") == ""
    assert main_text("<article>a<b>c</p>d<p>e") == "ac\nd\ne"
    assert main_text('<article><p title="x > y">a &amp b &am') == "a & b &am"
    assert main_text("<article>" + "<div>" * 5000 + "deep") == "deep"
    assert main_text("<article>a < b and <3 <" + "p" * 10) .startswith("a < b and <3")


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>x", 9), (None, None, None, 9), (1, "u", "<article><p>x", 9)], "page_id long, url string, html string, n_chars int")
    assert sorted(map(tuple, extract(pages).collect()), key=str) == [(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0)]
    assert extract(pages.where("false")).collect() == []


def test_long_page(spark):
    text = "the of and " * 200_000
    assert main_text(f"<article><p>{text}</p></article>") == text.strip()


def test_deep_pages_without_end_tags():
    """End tags that nothing opened cost no walk over what is open."""
    import time

    began = time.time()
    main_text("<div>" * 60000 + "</section>" * 60000 + "<p>end")
    assert time.time() - began < 20

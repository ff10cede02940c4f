"""Regions of pages whose text stands outside articles, or is short, or is a link."""

from dealscope.llm.html_text import main_text


def test_body_beside_teasers():
    page = "<body><div><p>%s</p><p>Second part.</p></div><article><h2>Teaser</h2></article></body>" % ("Body text. " * 20)
    assert main_text(page) == "\n\n".join((("Body text. " * 20).strip(), "Second part.", "Teaser"))


def test_short_regions_and_links_stay():
    gap = "<ul>" + "<li><a href='/'>x</a></li>" * 5 + "</ul>"
    page = f"<div><p>{'long ' * 50}</p></div>{gap}<div>Short end.</div>{gap}<p><a href='/'>A paragraph that is a link</a></p>{gap}"
    assert main_text(page).split("\n\n")[1:] == ["Short end.", "A paragraph that is a link"]  # the link lists between the dives go
    assert main_text("<div>one</div><div><a href='/'>two</a></div><div>three</div>") == "one\n\ntwo\n\nthree"


def test_ids_of_headings_do_not_mark():
    assert main_text("<article><h2 id='related'>Related work</h2><p class='notice'>Text</p><div class='related'>gone</div></article>") == "Related work\n\nText"


def test_names_that_only_sound_like_boilerplate():
    page = "<article><p class='share-price'>a</p><h2 class='section-header'>b</h2><ul class='related-work'><li>c</ul><div class='product-notice'>d</div><div class='cookie-notice'>x</div><div class='site-header'>x</div><p>Choose <label>this</label> one</p></article>"
    assert main_text(page) == "a\n\nb\n\nc\n\nd\n\nChoose this one"


def test_unclosed_advert_ends_at_the_next_block():
    assert main_text("<article><p>one</p><div class='ad'>buy<p>two</p><p>three</p></article>") == "one\n\ntwo\n\nthree"
    assert main_text("<article><p>one</p><div class='ad'>buy<p>now</p></div><p>three</p></article>") == "one\n\nthree"


def test_odd_tables(spark):
    from dealscope.llm import html_text

    long = "<div>" + "<p>word</p>" * 20_000
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>a</p>"), (3, "u", "<p>a</p>"), (None, "u", "<p x='unclosed>b"), (4, "u", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "'x' as n_chars")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(df).collect()))
    assert [g[:2] for g in got[:-1]] == [(0, got[0][1]), (1, ""), (2, ""), (3, "a"), (3, "a")] and got[-1][2] == 20_000 * 6 - 2
    assert html_text.extract(df.limit(0)).count() == 0

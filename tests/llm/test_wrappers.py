import pytest

from triage.llm.wrappers import align, blocks_of, extract, infer_wrappers, is_aside, main_region, main_texts, page_wrapper


def page(k, body, side=True):
    return (f'<!DOCTYPE html><html lang="en"><head><title>T {k}</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar x{k}">'
            f'<header><h2>Site</h2></header><nav><ul>{"".join(f"<li><a href=/{i}>menu {k}{i}</a></li>" for i in range(3 + k % 3))}</ul></nav><!-- ad {k} -->'
            f'<div class="ad">Buy {k}</div>{body}' + ('<div class="sidebar"><p>See also</p></div>' if side else "")
            + '<section id="comments"><p>First!</p></section><form><p>Mail <input></p></form><div class="cookie-notice">We use cookies</div><footer>&copy; x</footer></body></html>')


def article(k):
    return f"<article><h1>Head {k} &amp; more</h1><p><b>One\n  two.<br><p>Three <i>four</i>.</p><ul><li>a<li>b</ul></article>"


def plain(k):
    return f'<div id="c{k}"><div class="wrap"><h1>Head {k} &amp; more</h1><p>One   two. And a good deal more text than there is elsewhere.</p><p>Three <i>four</i>.</p></div></div>'


def test_blocks():
    got = [b.text for b in blocks_of("<p>a&nbsp;b<p>c<br>d <b>e</b>f<div>g<!-- h --></div>i<textarea>j</textarea>")]
    assert got == ["a b", "c d ef", "g", "i"]
    assert blocks_of(None) == [] and blocks_of("") == [] and [b.text for b in blocks_of("no tags & such < 3")] == ["no tags & such < 3"]


def test_wrapper_of_a_host():
    pages = [blocks_of(page(k, article(k), k % 2 == 0)) for k in range(6)]
    wrapper = []
    for p in pages:
        wrapper = align(wrapper, page_wrapper(p))
    assert main_region(wrapper)[-1] == "article"
    assert align(wrapper, []) == wrapper
    body = wrapper[0][3][0]
    side = [n for n in body[3] if n[1] == "div.sidebar"]
    assert body[2][0] == 6 and side[0][2][0] == 3  # optional: on half of the pages
    assert extract(pages[3], main_region(wrapper)) == "Head 3 & more\n\nOne two.\n\nThree four.\n\na\n\nb"


@pytest.mark.parametrize("body", [article, plain])
def test_main_texts(spark, body):
    rows = [(k, f"https://{'hot' if k % 3 else 'other'}.example.com/{k}", page(k, body(k), k % 2 == 0)) for k in range(30)]
    rows += [(100, None, None), (101, "not a url", ""), (102, "https://one.example.com/", page(1, body(1))), (None, "https://hot.example.com/", page(2, body(2))), (3, rows[3][1], rows[3][2])]
    full = [(i, u, h, "x", "y", "z") for i, u, h in rows]
    frame = spark.createDataFrame(full, "page_id bigint, url string, html string, host string, region string, text string")
    got = main_texts(frame.repartition(4)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.id in (100, 101):
            assert r.text == ""
        else:
            assert r.text.startswith("Head ") and "One two." in r.text and "Three four." in r.text
            assert not any(x in r.text for x in ("menu", "Buy", "See also", "First!", "Mail", "cookies", "Site", "©"))
    assert main_texts(frame.limit(0)).count() == 0


def test_one_wrapper_for_each_host(spark):
    rows = [("h" if k % 4 else "g", page(k, article(k))) for k in range(40)]
    got = infer_wrappers(spark.createDataFrame(rows, "host string, html string").repartition(6)).collect()
    assert sorted(r.host for r in got) == ["g", "h"]


def test_asides():
    assert is_aside("nav") and is_aside("div.ad") and is_aside("section.user-comments") and is_aside("div.cookie-banner box")
    assert not is_aside("div.content") and not is_aside("body.has-sidebar") and not is_aside("div.shadow") and not is_aside("main.menu")


def texts_of(html):
    return [b.text for b in blocks_of(html)]


def test_deep_nesting_neither_fails_nor_loses_text(spark):
    deep = "<div>" * 1500 + "<p>inside</p>" + "</div>" * 1500
    html = "<body><article><p>first of all some words</p>" + deep + "<div>" * 300 + "<div class=comments><p>rude</p></div>" + "</div>" * 300 + "</article></body>"
    assert texts_of(html) == ["first of all some words", "inside", "rude"]
    rows = spark.createDataFrame([(1, "http://a/1", html), (2, "http://a/2", html)], "page_id bigint, url string, html string")
    assert {r.text for r in main_texts(rows).collect()} == {"first of all some words\n\ninside"}


@pytest.mark.parametrize("flood", ["<a ", "<a b=\"", "<a b='>\" ", "<p x=\">\" ", "</p ", "<!", "<!--", "<", "<div><p>", "</b></i>", "= \"<a", "<a ="])
def test_floods_of_tags_end_soon(flood):
    import time

    start = time.process_time()
    blocks_of(flood * (300_000 // len(flood)))
    blocks_of("<p>" + flood * (100_000 // len(flood)) + "</p>")
    assert time.process_time() - start < 20


def test_quotes_count_only_behind_an_equals_sign():
    assert texts_of("<p title=it's>one</p><p>two</p><p title='it\">'>three</p>") == ["one", "two", "three"]
    assert texts_of("<p it's>one</p><p title = \"a>b\">two</p><p title=>three</p><p title= >four</p>") == ["one", "two", "three", "four"]
    assert texts_of("<p>5 < 6 and 7 > 6</p><p>a<b>c</b></p>") == ["5 < 6 and 7 > 6", "ac"]
    assert texts_of("<p>one</p><p title=\"never closed>two</p><p>three</p>") == ["one", "two", "three"]

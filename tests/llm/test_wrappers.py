"""The wrappers against an extractor of its own, and what they decide."""

from html.parser import HTMLParser

import pytest

from presslake.llm import wrappers
from presslake.session import read

DATA = "/root/testdata/sf0.001"
BREAKS = {"h1", "h2", "h3", "p", "div", "section", "li", "ul", "ol", "blockquote", "pre", "article", "aside", "nav", "form", "table", "tr", "td", "th", "figure", "figcaption", "header", "footer"}


class Plain(HTMLParser):
    """The blocks inside article elements, but for some elements, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.skip, self.run, self.blocks = 0, 0, [], []

    def cut(self):
        if text := " ".join("".join(self.run).split()):
            self.blocks.append(text)
        self.run = []

    def handle_starttag(self, tag, attrs):
        if tag in BREAKS:
            self.cut()
        if tag == "br":
            self.run.append(" ")
        self.open += tag == "article"
        self.skip += tag in ("aside", "nav", "form", "script", "style", "footer")

    def handle_endtag(self, tag):
        if tag in BREAKS:
            self.cut()
        self.open -= tag == "article"
        self.skip -= tag in ("aside", "nav", "form", "script", "style", "footer")

    def handle_data(self, data):
        if self.open and not self.skip:
            self.run.append(data)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string")


def texts(spark, rows):
    return {r.page_id: r.text for r in wrappers.extract(pages(spark, [(*r, "other") for r in rows])).collect()}


def test_same_as_a_plain_extractor_and_nothing_without_wrappers(spark):
    table = read(spark, DATA, "pages")
    got = {r.page_id: r.text for r in wrappers.extract(table).collect()}
    want = {}
    for r in table.collect():
        plain = Plain()
        plain.feed(r.html)
        plain.close()
        plain.cut()
        want[r.page_id] = "\n".join(plain.blocks)
    assert got == want and len(got) > 20
    hosted = wrappers.with_host(table)
    empty = hosted.select("host").distinct().selectExpr("host", "'[[0, \"#root\", \"#root\", false, false, 1, false, false, null, null, [], 0]]' wrapper")
    other = {r.page_id: r.text for r in wrappers.extract(table, empty).collect()}
    assert all(other[i] != got[i] for i in got)


def test_repeated_groups_optionals_and_slots():
    root = wrappers.Item("#root", "#root")
    for body in ("<h2>a</h2><p>x</p><h2>b</h2><p>y</p><p>z</p>", "<h2>a</h2><p>q</p><div class=box>Same</div>"):
        root.n += 1
        wrappers.align(root, wrappers.marked_page(wrappers.parse(f"<article>{body}</article>")))
    text = wrappers.expression(root)
    assert "(<h2>" in text and "</p>+)+" in text and "<div.box>" in text and "</div>?" in text and "<p>#</p>" in text
    assert wrappers.written(wrappers.restored(wrappers.written(root))) == wrappers.written(root)


def test_order_counts():
    root = wrappers.Item("#root", "#root")
    wrappers.align(root, wrappers.marked_page(wrappers.parse("<div class=a>1</div><div class=b>2</div>")))
    wrappers.align(root, wrappers.marked_page(wrappers.parse("<div class=b>2</div><div class=c>3</div>")))
    assert [k.key for k in root.kids] == ["div.a", "div.b", "div.c"] and [k.n for k in root.kids] == [1, 2, 1]


def test_article_without_marks_is_found_by_the_slots_of_all_pages(spark):
    page = "<html><head><title>T{i}</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li>Home<li>News</ul></nav><div class='cookie-notice'>We use cookies</div><div class='layout'><div class='story-text'><h1>Head {i}</h1><p>First &amp; <b>bold</b>\n para {i}<p>Second&nbsp;one {i}<form><p>Mail</p></form></div><aside>More</aside><div class='comments'><p>Nice {i}</p></div></div><footer>&copy; me</footer>"
    short = "<title>S</title><body><nav><ul><li>Home</ul></nav><div class='layout'><div class='story-text'><h1>S</h1></div><div class='box0'><p>A longer text of the template that stands beside it on every page</p></div></div>"
    long = "<title>L{i}</title><body><div class='layout'><div class='story-text'><h1>Head {i}</h1><p>Many words of the page {i} stand here, more than beside it</p></div><div class='box0'><p>A longer text of the template that stands beside it on every page</p></div></div>"
    rows = [(i, f"http://h.org/{i}", page.format(i=i)) for i in range(8)]
    rows += [(20 + i, f"http://l.org/{i}", long.format(i=i)) for i in range(6)] + [(30, "http://l.org/s", short)]
    rows += [(90, None, None), (91, "not a url", ""), (92, "http://p.org/x", "plain &lt;text&gt;"), (None, "http://a.org", "<article><h1>A</h1><p>x<div class=ad>buy</div></article>"), (93, "http://h.org/3", page.format(i=3))]
    got = texts(spark, rows)
    assert len(got) == len(rows)
    assert got[3] == got[93] == "Head 3\nFirst & bold para 3\nSecond one 3"
    assert got[90] == "" and got[91] == "" and got[92] == "plain <text>" and got[None] == "A\nx"
    assert got[30] == "S"  # the page alone would give the template's text


def test_texts_of_the_template_copies_named_sections_and_siblings(spark):
    page = "<title>T{i}</title><article><h1>H{i}</h1><p>P{i}</p><div class=box><p>Same on all</p></div></article>"
    lone = "<title>Lone</title><article><h1>L</h1><p>a</p><p>b</p><blockquote>Only quote</blockquote></article>"
    named = "<body class='single comments-open no-sidebar'><article class='post has-share'><h2 id='search-methods'>Search</h2><section class='related-work'><p>Work</p></section><p class=notice>N</p><p>E = <math><mi>mc</mi></math></p><div class='share-buttons'>Tweet</div></article>"
    rows = [(i, f"http://h.org/{i}", page.format(i=i)) for i in range(6)] + [(i, f"http://c.org/{i}", lone) for i in range(10, 17)]
    rows += [(20, "http://n.org", named), (21, "http://s.org", "<main><article><p>One</p></article><article><p>Two is longer</p></article></main>")]
    got = texts(spark, rows)
    assert got[3] == "H3\nP3" and got[12] == "L\na\nb\nOnly quote"
    assert got[20] == "Search\nWork\nN\nE = mc" and got[21] == "One\nTwo is longer"


#: A template without marks: its own texts are longer than many of the articles.
UNMARKED = "<title>T{i}</title><div class='top'><p>Welcome to the site that has many words of its own on every page of it</p></div><div class='ca'><div class='cb'><h1>Head {i}</h1><p>{words}</p></div><div class='cc'><p>Read what else the site has to say, which is a lot of words on every page</p></div></div><div class='low'><p>These words close every page of the site and are longer than some of its articles</p></div>"


def unmarked(n):
    return [(i, f"http://u.org/{i}", UNMARKED.format(i=i, words=" ".join(f"w{i}x{k}" for k in range(3 + 5 * (i % 5))))) for i in range(n)]


def alone(html):
    """The text of a page read through a wrapper of itself only."""
    own = wrappers.Item("#root", "#root")
    wrappers.align(own, wrappers.marked_page(wrappers.parse(html)))
    return wrappers.Reader(own).text(wrappers.parse(html))


def test_without_other_pages_of_the_host_the_text_is_worse(spark):
    rows = unmarked(30)
    want = {i: "\n".join([f"Head {i}", " ".join(f"w{i}x{k}" for k in range(3 + 5 * (i % 5)))]) for i, _, _ in rows}
    assert texts(spark, rows) == want
    assert sum(alone(html) == want[i] for i, _, html in rows) == 0


def test_a_mark_where_the_pages_have_no_words_of_their_own_decides_nothing(spark):
    page = "<title>T{i}</title><div class=teaser><article><p>The same teaser stands on all of the pages here</p></article></div><div class=x><h1>H{i}</h1><p>Own words {i} of the page, and more of them {i}</p></div>"
    got = texts(spark, [(i, f"http://t.org/{i}", page.format(i=i)) for i in range(9)])
    assert got == {i: f"H{i}\nOwn words {i} of the page, and more of them {i}" for i in range(9)}


def test_one_wrapper_for_any_partitioning_and_order(spark):
    rows = [(*r, "") for r in unmarked(60)]
    rows += [(100 + i, "http://m.org/x", f"<title>{i}</title><body><article><h2>a{i}</h2><p>x</p><h2>b</h2><p>y{i}</p>{'<div class=box>Same</div>' * (i % 3)}<ul><li>1<li>{i}</ul></article>", "") for i in range(40)]
    table = pages(spark, rows)
    found = []
    for frame in (table.coalesce(1), table.repartition(1), table.repartition(7), table.orderBy("page_id", ascending=False).repartition(3), table.repartition(31, "page_id")):
        found.append(({r.host: r.wrapper for r in wrappers.infer(wrappers.with_host(frame)).collect()}, {r.page_id: r.text for r in wrappers.extract(frame).collect()}))
    assert all(x == found[0] for x in found[1:]) and len(found[0][1]) == 100


def test_any_depth_and_any_length(spark):
    deep = "<body><article>" + "<div>" * 100_000 + "<p>deep</p>" + "</div>" * 100_000
    long = "<article>" + "<p>one &amp; two</p>" * 50_000 + "</article>"
    got = texts(spark, [(1, "http://d.org", deep), (2, "http://l.org", long), (3, "http://e.org", "<article><p>cut <b"), (4, "http://e.org", "</div></p>x<")])
    assert got[1] == "deep" and got[2] == "\n".join(["one & two"] * 50_000) and got[3] == "cut"


def test_wrappers_of_many_tasks_are_one(spark, monkeypatch):
    page = "<title>T{i}</title><div class=x><p>Slot {i} has many words</p></div><div class=y>Same for all of them</div>"
    rows = [(i, "http://hot.org/" + str(i), page.format(i=i), "") for i in range(200)]
    many = wrappers.with_host(pages(spark, rows).repartition(40))
    assert wrappers.infer(many).count() == 1
    got = wrappers.extract(pages(spark, rows).repartition(40)).collect()
    assert {r.text for r in got} == {f"Slot {i} has many words" for i in range(200)}
    monkeypatch.setattr(wrappers, "ITEMS", 4)
    root = wrappers.pruned(wrappers.restored(wrappers.infer(many).first().wrapper))
    assert sum(1 for _ in wrappers.walk(root)) == 4


def test_no_kind_of_element_is_dropped_however_many(spark):
    name = lambda n: "".join("abcdefghij"[int(d)] for d in str(n))  # digits don't tell classes apart
    page = "<title>T{i}</title><div class=lay><p>Day {i}</p><div class=own{own}>{words}</div></div>"
    rows = [(i, f"http://many.org/{i}", page.format(i=i, own=name(i), words="".join(f"<p class=x{name(i * 12_000 + k)}>word</p>" for k in range(12_000)))) for i in range(20)]
    assert texts(spark, rows) == dict.fromkeys(range(20), "\n".join(["word"] * 12_000))


def test_wrappers_sent_ahead_of_their_pages_read_the_same(spark, monkeypatch):
    rows = unmarked(40) + [(100 + i, f"http://v{i % 3}.org/{i}", UNMARKED.format(i=i, words=f"one{i} two{i} three{i}")) for i in range(30)]
    rows += [(200, None, None), (201, "http://none.org/", ""), (202, "no url", "<p>x</p>"), (None, "http://u.org/n", UNMARKED.format(i=0, words="a b c"))]
    want = texts(spark, rows)
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(wrappers, "PAGES", 7)
    assert texts(spark, rows) == want and len(want) == 74


def test_empty_table(spark):
    assert wrappers.extract(pages(spark, [])).count() == 0


if __name__ == "__main__":
    pytest.main([__file__])

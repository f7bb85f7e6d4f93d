import html as entities
import random
from html.parser import HTMLParser

import pytest

from lodestone.llm import html as ht

LONG = "The river ran past the houses and on to the mill, which had stood there for as long as anyone in the village could remember, and it was said that the miller kept a boat."
LONG2 = "It was late in the year when he came back to the house on the hill, and the door was not locked, so that he went in and sat by the fire that his brother had made for him."
LINKS = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul>'


def test_article_and_what_stands_around_it():
    page = f"""<!DOCTYPE html><html><head><title>Mill &amp; more</title><style>p{{}}</style><script>var t = "</p><p>{LONG}</p>";</script></head>
    <body class="with-sidebar"><header><h1>The Daily</h1><p>{LONG}</p></header><nav>{LINKS}</nav><!-- <p>{LONG}</p> -->
    <div class="cookie-notice">{LONG}</div><div class="ad">{LONG}</div>
    <article class="post has-sidebar"><header class="article-header"><h1>The old   mill</h1></header><p>{LONG}<p>Short &lt;one&gt;&nbsp;here.<aside><p>{LONG2}</p></aside>
    <p>a<b>b</b><i> c</i><br>d &#233;&eacute; &amp;amp; &am;</p><div class="share">Share this</div><ul><li>One point</li><li>Another</li></ul>
    <form><label>Mail</label><input value="x"></form><p>Last.</p><footer>Filed under <a href="x">mills</a></footer></article>
    <section id="comments"><article class="comment"><p>{LONG2}</p></article></section><aside>{LONG2}</aside><footer>&copy; {LONG}</footer></body></html>"""
    assert ht.main_text(page).split("\n") == ["The old mill", LONG, "Short <one> here.", "ab c d éé &amp; &am;", "One point", "Another", "Last."]


def test_pages_without_an_article():
    page = f"""<body><div>{LINKS}</div><p>Menu words</p><h1>The mill</h1><p>{LONG}</p><p>A short one.</p><p>{LONG2}</p><p>The end.</p>
    <h2>See too</h2><p><a href="/x">{LONG}</a></p><p>zzz {"qqq xxx " * 30}</p><p>All rights reserved</p></body>"""
    assert ht.main_text(page).split("\n") == ["The mill", LONG, "A short one.", LONG2, "The end."]
    assert ht.main_text(f"<div><div>{LONG}<div>{LONG2}</div>tail of it</div></div>").split("\n") == [LONG, LONG2, "tail of it"]
    assert ht.main_text("<p>Tiny page</p>") == "Tiny page"
    assert ht.main_text("no markup & no end") == "no markup & no end"


def test_teasers_are_not_the_article():
    page = f'<div id="story"><p>{LONG}</p><p>{LONG2}</p></div><article><h2>Next</h2><p>Short words.</p></article>'
    assert LONG in ht.main_text(page) and LONG2 in ht.main_text(page)


def test_headings_go_with_what_follows():
    page = f'<article><h1><a href="/here">The mill</a></h1><p>{LONG}</p><h2>Related</h2><ul><li><a href="/a">{LONG2}</a></li></ul></article>'
    assert ht.main_text(page).split("\n")[:2] == ["The mill", LONG] and LONG2 not in ht.main_text(page)
    assert ht.settle([True, None, False, None, None, True], [False] * 6, False) == [True, False, False, False, True, True]
    assert ht.settle([True, None, False], [False, True, False], False) == [True, False, False]


@pytest.mark.parametrize("tail", ["", "<p", '<p class="x', "<!-- open", "<script>var x", "</article", "<", "&am", "<a href='", "<![CDATA[", "</ p>"])
def test_cut_pages(tail):
    text = ht.main_text(f"<body><nav>{LINKS}</nav><article><p><b>{LONG}<br><p>{LONG2}{tail}")
    assert text.split("\n")[0] == LONG and text.split("\n")[1].startswith(LONG2)


def test_tags_that_are_not_closed_end_with_their_parent():
    assert ht.main_text(f'<div><nav>{LINKS}</div><div><p>{LONG}</p></div>') == LONG
    assert ht.main_text(f'<article><p>{LONG} <span class="ad">buy</span> on <a href=x>link</p><p>{LONG2}</p></article>').split("\n") == [f"{LONG} on link", LONG2]
    assert ht.main_text(f"<table><tr><td>{LONG}<td>{LONG2}</table>").split("\n") == [LONG, LONG2]
    assert ht.main_text(f'<p title="a > b">{LONG}</p>') == LONG
    assert ht.main_text(f'<p hidden>{LONG2}</p><p style="display: none">{LONG2}</p><div aria-hidden=true>{LONG2}</div><p>{LONG}</p>') == LONG


def test_work_is_linear():
    import time

    for piece in ("<a \"", "<p><b>", "</x>", "<!--", "<div class='a' ", "&#", "<td>", "<a href=x>"):
        began = time.perf_counter()
        ht.main_text(piece * 20_000)
        assert time.perf_counter() - began < 8, piece


class Plain(HTMLParser):
    """The article of a plain page by another parser: paragraphs and headings, nothing else."""

    def __init__(self):
        super().__init__()
        self.inside, self.lines, self.line = False, [], []

    def cut(self):
        self.lines.append(" ".join("".join(self.line).split()))
        self.line = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside, self.line = True, []
        elif tag in ("p", "h1"):
            self.cut()
        elif tag == "br":
            self.line.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.cut()
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.line.append(data)


def page(rnd, i):
    word = lambda: rnd.choice(["the", "of", "and", "mill", "fluß", "a&b", "x<y", "señor", "%%%", "on"])
    say = lambda n: entities.escape(" ".join(word() for _ in range(n)))
    body = "".join(f"<p>{'<b>' if rnd.random() < 0.2 else ''}{say(rnd.choice([1, 4, 40, 90]))}{rnd.choice(['</p>', '', '<br>' + say(3) + '</p>'])}" for _ in range(rnd.randint(1, 9)))
    return f"<html><head><title>{say(5)}</title></head><body><nav>{LINKS}</nav><div class='ad'>{say(9)}</div><article><h1>{say(6)}</h1>{body}</article><footer>&copy; {say(20)}</footer>{rnd.choice(['', '</body></html>'])}"


def test_query_equals_a_plain_parser(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, f"u{i}", page(rnd, i)) for i in range(120)] + [(200, "n", None), (201, "e", ""), (None, None, "<p>" + LONG * 3000), (None, None, "<p>" + LONG * 3000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in ht.op11_html_text(spark, str(tmp_path)).collect()}
    assert got[200].text == got[201].text == "" and got[200].n_chars == 0 and got[None].n_chars == len(LONG) * 3000
    for i, _, p in rows[:120]:
        other = Plain()
        other.feed(p)
        other.close()
        assert got[i].text == "\n".join(x for x in other.lines if x) and got[i].n_chars == len(got[i].text)


def test_odd_tables(spark, odd, none):
    out = ht.extract(odd, ["doc_id", "kept", "a.b c"], html="text").collect()
    assert len(out) == odd.count() and {r.doc_id: r.text for r in out}[4] == "Alpha beta gamma delta"
    assert ht.extract(none, ["doc_id"], html="text").collect() == []

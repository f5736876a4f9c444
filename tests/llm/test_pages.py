"""Page extraction against an independent reader, hostile pages, and WARC files."""

import gzip
import time
from collections import defaultdict
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pytest

from hexflow.llm import html_extract, warc


def texts(pages, wrapper=None):
    wrapper = html_extract.unpack(html_extract.pack(wrapper or html_extract.infer(pages)))
    return [" ".join(html_extract.extract(p, wrapper)) for p in pages]


class Reader(HTMLParser):
    """Text of the article element alone, blocks apart (the sample pages hold no furniture inside it)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.text = False, []

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag != "b":
            self.text.append(" ")

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        if tag != "b":
            self.text.append(" ")

    def handle_data(self, data):
        if self.inside:
            self.text.append(data)


def test_query_gives_the_articles_of_the_sample_pages(spark, small):
    from hexflow.llm import queries

    got = {r.page_id: r for r in queries.op6_html_extraction(spark, small).collect()}
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        reader = Reader()
        reader.feed(r.html or "")
        assert got[r.page_id].text == " ".join("".join(reader.text).split()) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_wrapper_decides_where_no_name_does():
    """The same page alone keeps the site's line and box; the host's wrapper takes them out."""
    page = "<body><div>Our town's paper</div><h1>Title {k}</h1><div class=c><h2>Summary</h2><p>The text number {k} is here and long enough</p><p>More {k}</p></div><div>Printed weekly</div></body>"
    pages = [page.format(k=f"n{k}") for k in range(6)]
    assert texts(pages)[2] == "Title n2 Summary The text number n2 is here and long enough More n2"
    alone = " ".join(html_extract.extract(pages[2], html_extract.infer(pages[2:3])))
    assert alone != texts(pages)[2] and "Our town's paper" in alone


def test_titles_and_constant_headings_stay():
    pages = [f"<h1>Title {k}</h1><h2>Summary</h2><p>Words that differ, number {k}</p>" for k in range(6)]
    assert texts(pages) == [f"Title {k} Summary Words that differ, number {k}" for k in range(6)]


def test_names_alone_take_nothing_out():
    page = "<nav>m</nav><article><p>Text {k}</p><div class='share-price'>Price {k}</div><section id='related-work'>Work {k}</section><div class='share-buttons'>tweet</div><div id='reader-comments'><p>first {k}</p></div><p>End <span class='ad'>buy <span>now</span> it</span> of {k}</p></article>"
    assert texts([page.format(k=k) for k in range(4)])[3] == "Text 3 Price 3 Work 3 End of 3"
    form = "<form id='aspnet'><div><nav><a href='/'>m{k}</a></nav><p>Para {k} words and words</p><p>More {k}</p></div></form>"
    assert texts([form.format(k=k) for k in range(4)])[1] == "Para 1 words and words More 1"


def test_pages_of_another_layout_are_their_own_host():
    pages = [f"<h1>Title {k}</h1><div class=body><p>One {k} long text</p><p>Two {k}</p></div>" for k in range(40)] + ["<h1>Other</h1><section><p>Else one</p><p>Else two</p></section>"]
    assert texts(pages)[-1] == "Other Else one Else two"


def test_options_without_end_tags_swallow_nothing():
    assert texts(["<select><option>A<option>B</select><p>Text</p>"]) == ["Text"]


def test_deep_nesting():
    page = "<div>" * 5000 + "<p>text {k}</p>" + "</div>" * 5000
    assert texts([page.format(k=k) for k in range(3)]) == ["text 0", "text 1", "text 2"]
    assert len(html_extract.expression(html_extract.infer([page]))) > 5000


HOSTILE = ["<script " * 130_000, "<a b='c' " * 110_000, '<a b="c ' * 110_000, "<!-- " * 200_000, "<div class='x" * 70_000 + "<p>a</p>", "</x>" * 250_000, "<b>" * 300_000, '<i class=">' * 90_000, "<" * 1_000_000, "<svg>" * 200_000, "<div>" * 200_000, "&amp" * 200_000]


@pytest.mark.parametrize("page", HOSTILE, ids=lambda p: p[:8])
def test_a_megabyte_of_broken_markup_takes_seconds(page):
    began = time.process_time()
    html_extract.extract(page, html_extract.infer([page, "<div><p>a</p></div>"]))
    warc.page_parts(page)
    assert time.process_time() - began < 30


def test_long_unlike_sequences_align_in_one_pass():
    a, b = [f"k{i % 7}" for i in range(9000)], [f"k{i % 5}" for i in range(9000)]
    pairs = html_extract._matched(a, b)
    assert pairs and all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_wrappers_of_many_tasks_merge(spark):
    page = "<div>Same here</div><h1>Title {k}</h1><div><p>Text number {k} of this host</p><p>And {k}</p></div>"
    rows = [(k, f"http://h.org/{k}", page.format(k=k)) for k in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)
    one = html_extract.wrappers(df, fan_in=2).collect()
    assert [r.host for r in one] == ["h.org"]
    w = html_extract.unpack(bytes(one[0].wrapper))
    assert w.pages == 30 and texts([rows[7][2]], w) == ["Title 7 Text number 7 of this host And 7"]


def test_warc_text_matches_an_independent_reader():
    class Lines(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.hidden, self.out, self.links = 0, [], []

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "head")
            self.out.append("\n" if tag in ("p", "li", "br", "div", "ul", "h1", "nav", "article", "footer") else "")
            self.links += [v for k, v in attrs if tag == "a" and k == "href"]

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "head")
            self.out.append("\n" if tag in ("p", "li", "div", "ul", "h1", "nav", "article", "footer") else "")

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)

    page = "<html><head><title>T &amp; t</title><style>p{}</style></head><body><nav><ul><li><a class=x href='/a?b&amp;c'>A</a></li></ul></nav><article><h1>H  h</h1><p>One<br>two <b>b</b>old&nbsp; x<p>three</article><footer>&copy; F</footer></body></html>"
    lines = Lines()
    lines.feed(page)
    wanted = [" ".join(x.split()) for x in "".join(lines.out).split("\n")]
    text, title, links = warc.page_parts(page)
    assert text == "\n".join(x for x in wanted if x) and title == "T & t" and links == lines.links == ["/a?b&c"]


def test_warc_files_round_trip(spark, tmp_path):
    rows = [(k, f"http://x.org/{k}", f"<p>page {k} é</p>\r\n\r\n" * (k + 1)) for k in range(7)] + [(7, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = warc.derivatives(warc.responses(pages))
    warc.write_files(made, str(tmp_path / "out"), "metadata", "conversion")
    warc.write_files(warc.responses(pages), str(tmp_path / "in"), "warc")
    back = warc.read_files(spark, str(tmp_path / "out")).collect()
    kinds = defaultdict(set)
    for r in back:
        kinds[r.type].add(bytes(r.warc))
    wanted = made.collect()
    assert kinds["metadata"] == {gzip.decompress(r.metadata) for r in wanted} and kinds["conversion"] == {gzip.decompress(r.conversion) for r in wanted}
    responses = warc.read_files(spark, str(tmp_path / "in")).filter("type = 'response'")
    assert {bytes(r.warc) for r in responses.collect()} == {warc.response_record(*r, "2024-01-01T00:00:00Z") for r in rows}
    (tmp_path / "members").mkdir()
    (tmp_path / "members" / "a.warc.gz").write_bytes(b"".join(r.conversion for r in wanted))
    assert warc.read_files(spark, str(tmp_path / "members")).count() == 8
    with pytest.raises(ValueError):
        list(warc.split_records(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort"))


def test_host_of_urls(spark):
    urls = ["http://a.org/x", "HTTPS://u:p@B.org:80/x?y", "x", None, "ftp://c.org"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(html_extract.host_of()).collect()] == [(urlsplit(u).hostname or "") if u else "" for u in urls]

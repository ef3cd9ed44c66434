"""Pages unlike the composed ones, labelled by hand, and broken markup."""

import time

import pytest

from gridloom.llm import dom_model

PAGES = [
    ("<article><h1>Soup</h1><p>Cook it well.</p><ul><li>salt</li><li>two onions</li><li>oil</li></ul></article>", "Soup\nCook it well.\nsalt\ntwo onions\noil"),
    ("<article><table><tr><td>c1<td>c2</table><ul><li>x<li>y</ul></article>", "c1\nc2\nx\ny"),
    ("<article><p>See the <a>one</a> and <a>two</a>.</p><p><a>A linked paragraph</a></p></article>", "See the one and two.\nA linked paragraph"),
    ("<p>Hello there</p>", "Hello there"),
    ("<html><body><p>A short page.</p></body></html>", "A short page."),
    ('<article><p class="x>Hello</p><p>World</p></article>', "Hello\nWorld"),
    ("<article><p>&am<b>p;</b> x &amp; y&nbsp;z</p></article>", "&amp; x & y z"),
    ('<article><p>Text here of it</p><div class="content-ad"><p>Buy</p></div></article>', "Text here of it"),
    ("<body><nav><ul><li><a href=x>Home</a></ul></nav><p>Only this.</p><footer>c 2020</footer>", "Only this."),
    ("<main><p>a<p>b</main>", "a\nb"),
    ("<main><p>a <!-- no <p>text --> b</p><p>1 < 2</p></main>", "a b\n1 < 2"),
    ("<article><p title='a > b'>kept</p></article><form><label>no</label></form>", "kept"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_pages_labelled_by_hand(page, text):
    assert dom_model.extract(page) == text


@pytest.mark.parametrize("piece", ['<a "', "<a ='", "<p>x</q>", "<!", "<b>", "<p><b></p>", "<", "</p>", "<!--", "<p x='", '<p x="">'])
def test_broken_pages_take_linear_time(piece):
    times = []
    for size in (100_000, 400_000):
        start = time.process_time()
        dom_model.Tree(piece * (size // len(piece)))
        times.append(time.process_time() - start)
    assert times[1] < 8 * times[0] + 0.5


def test_pages_of_the_table(spark):
    rows = [(1, "u", p, "x") for p, _ in PAGES] + [(1, "u", PAGES[0][0], "x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = dom_model.extracted(d).collect()
    assert sorted((r.text, r.n_chars) for r in got) == sorted((t, len(t)) for t in [*(t for _, t in PAGES), PAGES[0][1]])
    assert dom_model.extracted(d.limit(0)).count() == 0
    assert dom_model.extract("<article><p>" + "long " * 300_000 + "</p></article>") == ("long " * 300_000).strip()

"""Main text of hand-made pages."""

import pytest

from loomtrace.llm import block_text

LONG = (
    "The old bridge over the river was closed for most of the year, and the people who live on the other side of it had to walk for an hour to the "
    "nearest shop; it was opened again in the spring, when the work that had been planned for a decade was done at last."
)
LONGER = "It is said that the stones of the bridge came from a church that had stood in the town, which is why there are names on them. " * 2
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li></ul>'

FRAMED = [
    (f"<nav>{MENU}</nav><article><h1>A title</h1><p>{LONG}<p>Short.</article><footer>&copy; the people of the town</footer>", f"A title\n{LONG}\nShort."),
    (f'<body class="nav"><article><p>{LONG}<div class="ad">Buy the best of the best.</div><p>Yes &amp; no&nbsp;!</p></article>', f"{LONG}\nYes & no !"),
    ('<article><script>var t="</p><p>no";</script><style>p{}</style><p>Only <b>this</b>\n <i>one</i><br>here<!-- <p>not --></article>', "Only this one here"),
    ("<article><p>One</p><aside>Side</aside><form>Name <input></form><section id=comments><p>I was here first, and I like it.</p></section><p>Two</article>", "One\nTwo"),
    ("<article><header><h1>Title</h1></header><p>A &lt;b&gt; &quot;c&quot; &#233;&#x1F600; &amp;lt; &am</article>", 'Title\nA <b> "c" é😀 &lt; &am'),
    ("<article><ul><li>one item<li>two items<ul><li>inner</ul><li>three</ul><table><tr><td>a<td>b<tr><td>c</table></article>", "one item\ntwo items\ninner\nthree\na\nb\nc"),
    (f"<article><p>Cut off here {MENU[:0]}", "Cut off here"),
    ('<article><p>Seen <span style="display: none">not seen</span>again</p><div hidden><p>gone</div><p title="a > b">after</article>', "Seen again\nafter"),
    (f"<article>{MENU}<p>The <a href=x>whole line is a link</a></p></article>", "The whole line is a link"),
    ("<main><div class='notice'>We use cookies on this page.</div><p>Body</p></main><p>outside", "Body"),
    ("<ARTICLE><P>Upper</P><SCRIPT>x</SCRIPT ><p>Case</ARTICLE><div>no", "Upper\nCase"),
    ('<article><p>5 < 6 and a<b>c</b> "quoted" it\'s</p><!doctype x><?php x ?><p>end</article>', '5 < 6 and ac "quoted" it\'s\nend'),
]
FREE = [
    (f"<div>{MENU}</div><h2>Opened</h2><p>{LONG}</p><p>Really.</p><p>{LONGER}</p><div><a href=a>Imprint</a> <a href=b>Terms</a></div>",
     f"Opened\n{LONG}\nReally.\n{LONGER.strip()}"),
    (f"<p>Login</p><p>{LONG}</p><p>Done</p>", LONG),
    (f"<p>{LONG}</p><p>buy cheap lamps lamps tables chairs sofas beds desks carpets curtains mirrors shelves wardrobes now today fast</p>", LONG),
    ("", ""), ("no tags at all", ""), ("<p></p><nav>x</nav>", ""), ("<!-- never closed <p>x", ""), ('<p title="never closed>x', ""),
]


@pytest.mark.parametrize("page,want", FRAMED + FREE)
def test_pages(page, want):
    assert block_text.extract(page) == want


def test_short_blocks_inherit():
    short = block_text.Block("Short.", 0, False, False, False, False)
    good = block_text.Block(LONG, 0, False, False, False, False)
    menu = block_text.Block("Home", 4, False, True, False, False)
    assert block_text.labels_of([menu, short, good, short, short, good, short, menu]) == [False, False, True, True, True, True, False, False]
    assert block_text.labels_of([short]) == [False] and block_text.labels_of([]) == []


def test_long_and_hostile_pages_take_linear_time():
    for page in ("<p" * 200_000, "<!--" * 200_000, '<a b="' * 200_000, "<" * 500_000, "<p>x " * 100_000, "<script>" * 100_000, "<div>" * 50_000 + "x"):
        block_text.extract(page)


def test_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<article>x"), (2, "v", ""), (3, "w", "<article><p>" + "word " * 300_000)]
    df = spark.createDataFrame([(*r, 4, "t") for r in rows], "page_id bigint, url string, html string, n_chars int, text string")
    got = sorted(map(tuple, block_text.main_text(df).collect()), key=str)
    assert got == sorted([(1, "u", "", 0)] * 2 + [(None, None, "x", 1), (2, "v", "", 0), (3, "w", ("word " * 300_000).strip(), 1_499_999)], key=str)
    assert block_text.main_text(df.limit(0)).collect() == []

import html
import random

from quarryline.llm import htmltext


def test_boilerplate_goes():
    page = """<!DOCTYPE html><html class="has-sidebar"><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head>
    <body><header><h2>Site</h2></header><nav><ul><li><a href="/a">A</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy <div>now</div></div>
    <div id="cookie-notice">We use cookies</div><main><article><h1>Head &amp; line</h1><p>One <b>bo</b>ld&nbsp;\n word<br>more</p>
    <aside>side</aside><form><p>mail?</p></form><p><b>Open<br><p title="a > b">Two &lt;3 &eacute;</p><div class='social share'>f t</div><ul><li>x<li>y</ul>
    <section class="comments"><p>First!</p></section></article></main><div class="sidebar">S</div><footer>&copy; me</footer></body></html>"""
    assert htmltext.main_text(page) == "Head & line\nOne bold word more\nOpen\nTwo <3 é\nx\ny"


def test_page_without_article():
    body = "".join(f"<p>Sentence number {i} of the text.</p>" for i in range(5))
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div class=content>{body}</div><div class=footer>c</div></body>"
    assert htmltext.main_text(page).split("\n") == [f"Sentence number {i} of the text." for i in range(5)]


def test_interrupted_text_without_article():
    part = lambda k: "".join(f"<p>Sentence {i} of part {k}, {'long ' * k}</p>" for i in range(4))
    adverts = "".join(f"<div class=ad>Buy {i}</div>" for i in range(htmltext.WINDOW + 1))
    page = f"<body><div class=nav>Home</div>{part(1)}{adverts}{part(9)}{adverts}{part(2)}<div class=footer>c</div></body>"
    assert htmltext.main_text(page).split("\n") == [
        f"Sentence {i} of part {k}, {'long ' * k}".strip() for k in (1, 9, 2) for i in range(4)]


def kept_lines(weights, window):
    """Lines that no window of zero weight covers, by trying every window for every line."""
    size = max(1, min(window, len(weights)))
    windows = [range(i, i + size) for i in range(len(weights) - size + 1)]
    return [i for i in range(len(weights)) if all(any(weights[k] for k in w) for w in windows if i in w)]


def test_surge_and_dive_points():
    assert htmltext.sums([1, 2, 3, 4], 3) == [6, 9] and htmltext.sums([1, 2], 3) == [3] and htmltext.sums([], 3) == []
    assert htmltext.stretches([0, 3, 0, 0, 4, 0, 0, 0, 5, 0], 3) == [(0, 5, 4), (8, 10, 5)]
    assert htmltext.stretches([0, 3, 0, 0, 4], 1) == [(1, 2, 3), (4, 5, 4)]
    assert htmltext.stretches([], 3) == [] and htmltext.stretches([0, 0], 3) == []
    r = random.Random(2)
    for _ in range(500):
        weights, window = [r.choice([0, 0, 0, 1, 7]) for _ in range(r.randrange(16))], r.randrange(1, 6)
        runs = htmltext.stretches(weights, window)
        assert [i for a, b, _ in runs for i in range(a, b)] == kept_lines(weights, window)
        assert all(top == max(sum(weights[i : i + min(window, len(weights))]) for i in range(len(weights))
                              if i + min(window, len(weights)) <= len(weights) and i < b and i + min(window, len(weights)) > a) for a, b, top in runs)


def test_windows_decide_what_stays():
    """Links alone stay near text and go in runs, and how long a run is the window says; in an article they are text."""
    link = lambda k: f"<p><a href=/{k}>Link {k}</a> |</p>"
    text = f"<p>One text.</p>{link(1)}{link(2)}<p>Two text.</p>{link(3)}"
    want = {1: "One text.\nTwo text.", 2: "One text.\nTwo text.", 3: "One text.\nLink 1 |\nLink 2 |\nTwo text."}
    assert {k: htmltext.main_text(f"<nav>m</nav><div>{text}</div>", k) for k in want} == want
    whole = "One text.\nLink 1 |\nLink 2 |\nTwo text.\nLink 3 |"
    assert {htmltext.main_text(f"<nav>m</nav><article>{text}</article>", k) for k in want} == {whole}
    listed = "".join(link(k) for k in range(9))
    assert htmltext.main_text(f"<div><p>Short.</p><ul>{listed}</ul><p>{'long ' * 99}</p></div>") == "Short.\n" + ("long " * 99).strip()
    assert htmltext.main_text(f"<article><p>Text.</p>{listed}</article>").count("\n") == 9


def plainly(page, window):
    """The text by trying, for every line, all windows that cover it, over blank lines put in by hand."""
    found = htmltext.lines(page)
    named = any(inside and not apart for _, _, apart, inside in found)
    places = [(0, None)] * window
    for k, (text, plain, apart, inside) in enumerate(found):
        out = bool(apart) or named and not inside
        before = k > 0 and (bool(found[k - 1][2]) or named and not found[k - 1][3])
        if out != before:
            places += [(0, None)] * window if out or k else []
        places.append((0 if out else len(text) if named else plain, text))
    places += [(0, None)] * window
    covered = lambda i: [sum(w for w, _ in places[j : j + window]) for j in range(max(0, i - window + 1), min(i, len(places) - window) + 1)]
    return "\n".join(text for i, (_, text) in enumerate(places) if text is not None and all(covered(i)))


def test_equals_the_distribution_by_brute_force():
    r = random.Random(8)
    parts = ["<p>Some text.</p>", "<p><a href=1>Link</a></p>", "<nav><a href=2>N</a></nav>", "<div class=ad>Buy</div>", "<aside><p>s</p><p>t</p></aside>", "<p>A <a href=3>b</a></p>", "<hr>"]
    for k in range(300):
        some = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        page = [f"<body>{some}</body>", f"<body>{some}<article>{some}</article>{some}</body>"][k % 2]
        for window in (1, 2, 3, 4):
            assert htmltext.main_text(page, window) == plainly(page, window), (page, window)


def test_sums_choose_on_the_drivers_pages(sf_dir):
    """On these pages text is right because of the sums: all lines would be too many, and the article's tag isn't needed."""
    import pyarrow.parquet as pq

    pages = pq.read_table(f"{sf_dir}/pages.parquet")["html"].to_pylist()
    for page in pages:
        got = htmltext.main_text(page)
        assert got == plainly(page, htmltext.WINDOW) and got
        assert got != "\n".join(x[0] for x in htmltext.lines(page))
        assert got == htmltext.main_text(page.replace("<article", "<div").replace("</article", "</div").replace("<main", "<div").replace("</main", "</div"))


def test_end_tags_may_be_missing():
    one = htmltext.main_text
    assert one("<article><p class=ad>Buy<p>text one<p>two</article>") == "text one\ntwo"
    assert one("<article><ul><li class=share>Share<ul><li>x</ul><li>text</ul><p>y</article>") == "text\ny"
    assert one("<article><p class=ad>Buy<ul><li>in</ul><p>t</article>") == "in\nt"
    assert one("<div><p class=ad>x</div><p>kept") == "kept"
    assert one("<table><tr><td class=sidebar>s<td>text<tr class=nav><td>n<tr><td>last</table>") == "text\nlast"
    assert one("<article><dl><dt class=ad>a<dd>text<dt>term</dl></article>") == "text\nterm"


def test_a_form_around_the_page_is_its_frame():
    one = htmltext.main_text
    assert one("<body><form><nav>n</nav><p>One text of the page.<p>Two. <input name=q><button>Go</button><label>l</label></form></body>") == "One text of the page.\nTwo."
    assert one("<body><article><form><p>mail?</p></form><p>Much more text than the form has.</p></article></body>") == "Much more text than the form has."


def test_article_keeps_all_but_what_is_apart():
    one = htmltext.main_text
    related = "<div class=related><p>a</p><p>b</p><p>c</p></div>"
    assert one(f"<article><p>First.</p>{related}<p>Second.</p></article>") == "First.\nSecond."
    assert one('<article><p class="related-work">R</p><p class="notice-of-award">N</p><p id="adBanner">x</p><p class="cookie-notice">y</p>'
               '<p class="ad-slot-1">z</p><p class="has-sidebar">S</p></article>') == "R\nN\nS"
    assert one('<article><p title="abc>hello</p><p class="x">there</p></article>') == "hello\nthere"
    assert one("<article><p title='a > b' id=\"q\">x</p><p data=it's>y</p><p") == "x\ny"
    assert one("<article><p>A <svg><text>t</text></svg>b <video><p>no</p></video>c <span class=ad>buy <b>now</b></span>d</p>"
               "<p>e <span class=ad>open</p><p>f</p></article>") == "A b c d\ne\nf"


def test_generated_pages_give_their_blocks(spark):
    r = random.Random(1)
    pages, want = [], {}
    for i in range(80):
        blocks = [" ".join(r.choice(["a<b", "x&y", "é", "word"]) for _ in range(r.randrange(1, 30))) for _ in range(r.randrange(0, 12))]
        inner = "".join(r.choice(["<p>%s</p>", "<p><b>%s<br>", "<div>\n %s </div>", "<P CLASS=x>%s"]) % html.escape(b) for b in blocks)
        pages.append((i, f"http://x/{i}", f"<html><body><nav>m</nav><div class=\"ad\">ad</div><article>{inner}</article><footer>f</footer>"))
        want[i] = "\n".join(blocks)
    pages += [(100, None, None), (101, "u", ""), (102, "u", "plain words"), (103, "u", "<p>" + "long " * 50_000), (None, "u", "<p>x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = {r.page_id: r for r in htmltext.extract(df).collect()}
    assert all(got[i].text == t and got[i].n_chars == len(t) for i, t in want.items())
    assert [got[i].n_chars for i in (100, 101, 102, 103, None)] == [0, 0, 11, 249_999, 1]
    assert htmltext.extract(df.limit(0)).count() == 0

import random
import re
import time

from gleanery.llm import html_text
from gleanery.llm.html_text import visible_text


def test_implied_tags_lists_and_tables():
    page = "<title>T</title><ul><li>One<li>Two<ol start=3><li>a<li>b<br>more</ol></ul><h1>Head &amp; x</h1><p>para <b>bold<p>second\n  para"
    assert visible_text(page) == "- One\n- Two\n  3. a\n  4. b\n     more\n\nHead & x\n\npara bold\n\nsecond para"
    table = "<table><tr><th>Name<th>Val<tr><td>abc<td>1<tr><td>d<td>22</table>"
    assert visible_text(table) == "Name | Val\nabc  | 1\nd    | 22"


def test_hidden_text():
    page = '<head><style>p{}</style></head><p>a<span hidden>b</span><i style="Display : none">c</i><b aria-hidden="true">d</b><!-- e --><script>var f="</p>";</script><noscript>g</noscript><p>h'
    assert visible_text(page) == "a\n\nh"


def test_pre_and_depth():
    assert visible_text("<pre>  x\n   y</pre>z") == "  x\n   y\n\nz"
    assert visible_text("<div>" * 5000 + "deep") == "deep"
    assert visible_text("<table><tr><td>" * 300 + "cell").strip() == "cell"


def test_all_text_survives():
    page = "<div>one<p>two</div>three<table>loose<tr><td>four</td></tr></table></span></p>five<li>six<dt>seven<dd>eight<select><option>nine<option>ten</select>"
    for word in ("one two three loose four five six seven eight nine ten").split():
        assert word in visible_text(page)


def test_text_after_an_open_head():
    assert visible_text("<head><title>T</title><h1>Hi</h1><p>Text") == "Hi\n\nText"
    assert visible_text("<html><head><meta charset=utf-8><link href=x><style>p{}</style><table><tr><td>a<td>b</table>") == "a | b"
    assert visible_text("<head><script>x()</script><template><p>no</template><ul><li>one") == "- one"


def test_text_of_tables_outside_cells():
    assert visible_text("<table><form><tr><td>x<td>y<tr><td>z</form></table>") == "x | y\nz"
    assert visible_text("<table><tr><form><td>x</td><td>y</td></form></tr></table>") == "x | y"
    assert visible_text("<table><tr><td>a</td></tr><div>note</div>see <b>this</b><tbody>in <tr>row<td>b</table>end") == "note\nsee this in row\n\na\nb\n\nend"
    assert visible_text("<table><form><p>ask</p><tbody><tr><td>q</td></tr></tbody></form><form hidden><tr><td>no</table>") == "ask\n\nq"
    assert visible_text("<table><tr><table><td>i</table></table>") == "i"
    words = [f"w{i}" for i in range(9)]
    page = "<table>{}<div>{}</div><caption>{}</caption><thead>{}<tr>{}<th>{}</th><form><span>{}</span><td>{}</td></form></thead><center>{}</center></table>".format(*words)
    assert sorted(visible_text(page).replace("|", " ").split()) == words
    deep = "<table>" + "<div>" * 20_000 + "<tr><td>x"
    assert visible_text(deep) == "x"


def test_visibility():
    assert visible_text('<p style="backface-visibility:hidden">a<p style="color:red;visibility : hidden">b<b style="VISIBILITY:visible">c</b>d<i>e</i>') == "a\n\nc"
    assert visible_text('<ul style="visibility:hidden"><li>x<li style="visibility:visible">y</ul><img alt=z style="visibility:hidden"><p style="not-display:none">q') == "- y\n\nq"
    assert visible_text('<table style="visibility:collapse">s<tr><td>t<td style="visibility:visible">u</table>') == " | u"  # a cell without visible text keeps its place


def test_spans():
    assert visible_text("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>") == "A | B\n  | C"
    assert visible_text("<table><tr><td colspan=2>AA<td>B<tr><td>c<td>d<td>e<tr><td colspan=900>f<td>g</table>") == "AA |   | B\nc  | d | e\nf  |   |   | g"
    assert visible_text("<table><tr><td>a<td rowspan=3 colspan=2>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>") == "a | b | c\nd |   | e\nf |   | g"
    wide = "<table>" + "<tr><td colspan=1000 rowspan=9>x<td>y" * 50 + "</table>"
    assert len(visible_text(wide)) < 100_000


def test_time_is_linear_in_depth():
    def seconds(page):
        began = time.process_time()
        visible_text(page)
        return time.process_time() - began

    for piece in ("<div>x</span></p>", "<ul><li>x", "<b>x<section></i>", "<p><span><li>x", "<dl><dt>x<span>"):
        assert seconds(piece * 16_000) < 12 * max(0.02, seconds(piece * 4_000)), piece


def test_words_of_different_blocks_stay_apart():
    assert visible_text("x<br>y</p>z") == "x\ny\n\nz"
    assert visible_text("<p>a<select><option>One<option>Two</select>b") == "a\nOne\nTwo\nb"
    assert visible_text("<p>a<datalist><option>no</datalist>b") == "ab"
    rng = random.Random(6)
    breaks = "<p> </p> <div> <li> <tr> <td> <h2> <option> <br> <dt> <section> <table> <pre>".split()
    inline = "<b> </b> <span> </i> <select> </div> </table> <form> </select> </td>".split()
    for _ in range(600):
        out, n = [], 0
        for _ in range(rng.randrange(1, 14)):
            n += 1
            out.append(f"w{n}x" + "".join(rng.choices(inline, k=rng.randrange(3))) + rng.choice(breaks) + "".join(rng.choices(inline, k=rng.randrange(3))))
        text = visible_text("".join(out))
        assert sorted(re.findall(r"w[0-9]+x", text)) == sorted(f"w{i + 1}x" for i in range(n)), "".join(out)
        assert not re.search("xw", text), "".join(out)


def test_comments_details_and_dialogs():
    assert visible_text("<p>a<!-- b <p>c") == "a"
    assert visible_text("<p>a<!-- b --><i>c</i><!-- d") == "ac"
    assert visible_text("<details>x<summary>s</summary><p>y</details><details open><summary>t</summary>z</details>") == "s\nt\nz"
    assert visible_text("<dialog>x</dialog><dialog open>y</dialog>") == "y"


def test_spans_take_little_time_and_padding_is_bounded():
    def seconds(page):
        began = time.process_time()
        visible_text(page)
        return time.process_time() - began

    def page(cells, rows):
        return "<table><tr>" + "<td colspan=1000 rowspan=65534>x" * cells + "<tr><td>y" * rows

    assert seconds(page(320, 700)) < 0.5  # 16 KB
    assert seconds(page(3200, 7000)) < 5
    ladder = "<table><tr>" + "".join(f"<td rowspan={i + 2}>" for i in range(4000)) + "<tr><td>z" * 4000
    assert seconds(ladder) < 5
    for big in ("<table><tr><td>" + "long " * 20_000 + "<tr><td>a<td>b" * 1000, "<table><tr>" + "<td>" + "w" * 80 + "".join("<td>" + "w" * 80 for _ in range(1000)) + "<tr><td colspan=1000>x<td>y" * 1000, "<table><tr><td>" * 7 + "v" * 5000 + "<tr><td>q" * 500):
        assert len(visible_text(big)) < 10 * len(big) + 20_000
    assert visible_text("<table><tr><td>" + "long " * 20_000 + "<tr><td>a<td>b" * 1000).endswith("\na" + " " * 39 + " | b")
    assert visible_text("<table><tr><td rowspan=2>A<td rowspan=3>B<td>C<tr><td>D<tr><td>E<td>F") == "A | B | C\n  |   | D\nE |   | F"
    assert visible_text("<table><tr><td>a<td rowspan=2>b<tr><td colspan=3>c<td>d") == "a | b\nc |   | d"


def test_random_trees_keep_every_visible_word():
    rng = random.Random(3)
    tags = "div p ul ol li table tr td th tbody form span b section h2 dl dt dd blockquote pre a select option caption body".split()
    hides = ("hidden", "style='display:none'", "aria-hidden=true")
    for _ in range(400):
        shown, hidden, out, n = [], [], [], 0
        for _ in range(rng.randrange(60)):
            n += 1
            if rng.random() < 0.1:
                # A hidden element that ends where its own text ends.
                hidden.append(f"w{n}x")
                out.append(f"<span {rng.choice(hides)}>w{n}x</span>")
            elif rng.random() < 0.4:
                shown.append(f"w{n}x")
                out.append(f" w{n}x ")
            else:
                out.append(f"<{rng.choice(('', '', '/'))}{rng.choice(tags)}>")
        found = re.findall(r"w[0-9]+x", visible_text("".join(out)))
        assert sorted(found) == sorted(shown), "".join(out)


def test_frame(spark):
    rows = [(1, "u", "<p>x"), (1, "u", "<p>x"), (2, None, None), (3, "u", ""), (None, "u", "<b>y</b>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' as text")
    found = [(r.page_id, r.text) for r in html_text.extract(pages).collect()]
    assert sorted(found, key=str) == sorted([(1, "x"), (1, "x"), (2, ""), (3, ""), (None, "y")], key=str)
    assert html_text.extract(pages.limit(0)).count() == 0

import random
import time

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import html_text as h

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<nav><ul><li><a href="/a">alpha</a></li><li><a href="/b">beta</a></li><li><a href="/c">gamma</a></li></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy this thing now.</div>
<article><h1>Title &amp; more</h1><p><b>First   paragraph of the\n text, long enough to count. It goes on for a while.<br><p>Second paragraph &eacute;t&#233;, which is also rather long. It has words.</p></article>
<footer>&copy; site &middot; some words at the end.</footer></body></html>"""


def run(pages):
    return h.extract(pages, h.model())


def test_article():
    want = "Title & more\nFirst paragraph of the text, long enough to count. It goes on for a while.\nSecond paragraph été, which is also rather long. It has words."
    assert run([PAGE]) == [want]
    assert run([PAGE[: PAGE.index("</article>") + 3]]) == [want]  # cut off in a tag


def test_empty_and_broken():
    assert run([None, "", "   ", "<p", "<!-- x"]) == [""] * 5
    assert run(["just plain   text &lt;b&gt;"]) == ["just plain text <b>"]
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert len(run([deep])) == 1
    assert len(run(["<a href='" + "x" * 20000, "< <> </> <<<p>>", "</p></div></body>"])) == 3


def test_very_long_page():
    body = "".join(f"<p>Paragraph number {i} has some words in it, and more of them follow.</p>" for i in range(4000))
    got = run([PAGE.replace("<p>Second", body + "<p>Second")])[0]
    assert got.count("\n") == 4002


def test_made_pages_held_out():
    rnd, right, total = random.Random(77), 0, 0
    for _ in range(150):
        blocks = h._blocks(h.nodes_of(h.parse(h.sample_page(rnd))))
        h.decode(blocks, h.model().chance(h.node_features(blocks)))
        right += sum((b.state == h.INSIDE) == (b.truth == "1") for b in blocks)
        total += len(blocks)
    assert right / total > 0.95


def test_decoding_is_consistent():
    rnd = random.Random(5)
    for _ in range(40):
        blocks = h._blocks(h.nodes_of(h.parse(h.sample_page(rnd))))
        h.decode(blocks, np.array([rnd.random() for _ in blocks]))
        known = {id(b): b for b in blocks}
        for b in blocks:
            if (p := known.get(id(b.parent))) is not None:
                assert not (p.state == h.NOISE and b.state != h.NOISE)
                assert not (p.state == h.INSIDE and b.state == h.AROUND)


def test_decoding_finds_the_best_reading():
    """Against all labelings of trees of up to eight nodes."""
    from itertools import product

    rnd = random.Random(6)
    for _ in range(150):
        nodes = [h.Node("div", (), None)]
        for _ in range(rnd.randint(1, 7)):
            nodes.append(h.Node("div", (), rnd.choice(nodes)))
        chance = np.array([rnd.random() for _ in nodes])
        number = {id(b): i for i, b in enumerate(nodes)}
        up = [number.get(id(b.parent), -1) for b in nodes]

        def worth(states, up=up, chance=chance):
            total = 0.0
            for i, s in enumerate(states):
                above = h.AROUND if up[i] < 0 else states[up[i]]
                if above == h.AROUND and s == h.NOISE or above == h.INSIDE and s == h.AROUND or above == h.NOISE and s != h.NOISE:
                    return -1e9
                total += np.log(chance[i] if s == h.INSIDE else 1 - chance[i]) + (h.ENTER if above == h.AROUND and s == h.INSIDE else 0)
            return total

        h.decode(nodes, chance)
        best = max(worth(s) for s in product((h.AROUND, h.INSIDE, h.NOISE), repeat=len(nodes)))
        assert abs(worth([b.state for b in nodes]) - best) < 1e-9


def test_controls_and_dialogs_go():
    whole = run([PAGE])[0]
    for part in ("<select><option>One<option>Two</select>", "<button>Buy</button>", "<label>Email</label>", "<select><option>a</option></select><label>b <button>c</button></label>"):
        assert run([PAGE.replace("First", f"First{part}")]) == [whole], part
    notice = '<dialog class="cookie-consent"><p>We use cookies on this site. Accept them all.</p><button>Ok</button></dialog>'
    assert run([PAGE.replace("<p>Second", f"{notice}<p>Second")]) == [whole]
    assert run([PAGE.replace("<p>Second", "<p style='Display : none'>Gone, and it was long enough.</p><p>Second")]) == [whole]


def test_blocks_inside_paragraphs_stay():
    inner = "<p>One sentence is here, and it is long enough to count.<div>Two follows it, and has words of its own, too.</div>three goes on.</p><p>Second"
    got = run([PAGE.replace("<p>Second", inner)])[0].split("\n")
    assert got[2:5] == ["One sentence is here, and it is long enough to count.", "Two follows it, and has words of its own, too.", "three goes on."]


def test_query_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (None, None, None), (2, "v", ""), (1, "u", PAGE)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    rows = h.main_text(pages).collect()
    assert len(rows) == 4 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert h.main_text(pages.limit(0)).count() == 0


def test_nothing_of_an_article_is_dropped():
    whole = run([PAGE])[0]
    for names in ('class="overflow-hidden"', 'class="hidden-xs"', 'id="not-hidden"', 'title="a hidden thing"', 'style="overflow: hidden"'):
        assert run([PAGE.replace("<article>", f"<article {names}>")]) == [whole], names
        assert run([PAGE.replace("<article>", f"<div {names}><article>").replace("</article>", "</article></div>")]) == [whole], names
    assert run([PAGE.replace("</head>", "")]) == [whole]
    assert run([PAGE.replace("</head>", "").replace("<body>", "")]) == [whole]
    assert run([PAGE.replace("First", "<math><mi>x</mi></math> <object>other</object> <svg><text>label</text></svg> First")]) == [whole.replace("First", "x other label First")]
    assert run(["<head><title>t</title>plain text"]) == ["plain text"]


def test_hidden_elements_go():
    whole = run([PAGE])[0]
    for names in ("hidden", "HIDDEN", 'hidden=""', 'hidden="hidden"', 'class="a" hidden', 'style="color: red; visibility: hidden"'):
        assert run([PAGE.replace("<p>Second", f"<p {names}>Gone, and it was long enough to count.</p><p>Second")]) == [whole], names


def test_all_siblings_count():
    sizes = [3] * 300 + [90] + [7] * 250
    page = "<body>" + "".join(f"<{'div' if i < 300 else 'p'}>{'x' * n}</{'div' if i < 300 else 'p'}>" for i, n in enumerate(sizes)) + "</body>"
    blocks = h._blocks(h.nodes_of(h.parse(page)))
    f = h.node_features(blocks)[1:]
    assert np.allclose(f[:, 17], np.array(sizes) / max(sizes))
    assert np.allclose(f[:, 16], [(300 if i < 300 else 251) / 551 for i in range(551)])


def test_attributes_are_read_as_html_does():
    whole = run([PAGE])[0]
    for names in ("class=it's", "title=\"a > b\"", "title='say \"x\"'", "data-x=a'b\"c", "a b=c d='e' f=\"g\"/", "class = 'x' '", "x=y=z", "\"odd\"=1", "a=<b"):
        assert run([PAGE.replace("<p>Second", f"<p {names}>Second")]) == [whole], names
        assert run([PAGE.replace("<article>", f"<article {names}>")]) == [whole], names
    assert h.attributes("a x=1 Y='2 3' z=\"4\" w =5 v>t", 1) == (27, {"x": "1", "y": "2 3", "z": "4", "w": "5", "v": ""}, False)
    assert h.attributes("a/>", 1) == (3, {}, True) and h.attributes("a b='c>d", 1) == (7, {"b": "'c"}, False) and h.attributes("a b", 1)[0] == -1


def test_hostile_pages_take_linear_time():
    n = 1_000_000
    parts = ["<a '", "<a ", "<a b='", '<a b="', "<!--", "<", "</", "<div>", "</x>", "<p>", "<b>", "<b><p>", "<li>", "<div></x>", "<b><div></x>", "<head><template><div>", "&#9", "&amp", "<td>", "<svg><p>x", "<a b=' c=\""]
    for part in parts:
        page = f"<p>start</p>{part * (n // len(part))}"
        root_time = time.time()
        h.nodes_of(h.parse(page))
        assert time.time() - root_time < 20, part  # a quadratic reading of a megabyte takes hours
    for part in ("<a '", "<a ", "<div>x", "<b>x", "x</x>", "<p>x", "<b><p>x", "<li>x"):
        assert len(run([f"<p>start</p>{part * (100_000 // len(part))}"])) == 1


def test_character_references():
    assert h.decoded("&#" + "9" * 5000 + ";x") == "\ufffdx" and h.decoded("&#x" + "f" * 9 + ";") == "\ufffd"
    assert h.decoded("&#" + "0" * 5000 + "65;&#x0041;&#65;&#x41") == "AAAA" and h.decoded("&amp;#65;") == "&#65;"

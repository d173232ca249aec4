"""Markup: hand-made pages of each kind, pages that only look like markup, and the vote."""

import re
import time

import pytest

from cairn.llm import markup as M

PAGES = {
    "html": ("<html><head><title>t</title><style>p {}</style></head><body><h1\n style='x'><b>One</b></h1><p>a <a href=\"#\">b</a> &amp; c</p><ul><li>x\n<li>y <ol><li>z</li></ol></ul><pre>\n# no\n* no\n</pre><!-- <h2>no</h2> --><math><mi>x</mi></math> \\(y\\) <code>$n$</code></body></html>", dict(heading=1, list_item=3, code_block=1, formula=2)),
    "markdown": ("# A\n\ntext *em* and `# no`\n\nB\n===\n\n* x\n  * y\n1. z\n\n```py\n# no\n- no\n$x$\n```\n\n    ## no\n    1. no\n\nsee $x^2$ here\n\n$$\na\n$$\n\n~~~\nopen to the end\n", dict(heading=2, list_item=3, code_block=3, formula=2)),
    "wiki": ("== A ==\n\n'''b''' [[c|d]] {{e|f}}\n\n# one\n# two\n## three\n* four\n\n===B===\n\n:<math>x</math>\n\n<syntaxhighlight lang=\"x\">\n== no ==\n</syntaxhighlight>\n[[Category:Z]]", dict(heading=2, list_item=4, code_block=1, formula=1)),
    "latex": ("\\documentclass{article}\n\\begin{document}\n\\section*{A}\n% \\section{no}\ntext \\emph{b}~\\cite{c}\n\\begin{itemize}\n\\item x\n\\item y\n\\end{itemize}\n\\begin{verbatim}\n\\section{no}\n\\end{verbatim}\n\\[ z \\] and $w$\n\\begin{align*}\nq\n\\end{align*}\n\\end{document}", dict(heading=1, list_item=2, code_block=1, formula=3)),
    "mixed": ("<p>a</p>\n\n## B\n\n- c\n\n$d$", dict(heading=1, list_item=1, formula=1)),
}
LEFTOVERS = ["a <br> b", "x</div>", "a **b** c", "a _b_ c", "a &nbsp; b", "see [a](b.md)", "![a](b.png)", "[[a]]", "{{a|b}}", "''a''", "\\textbf{a}", "{\\bf a} b", "a~\\ref{b}", "~~a~~", "`a`", "a[^1]", "<!-- a -->", "a <ref>b</ref>", "&#8212;"]
PLAIN = ["", " ", "Both C# and F# were tried.", "2 * 3 * 4 before file_name_old", "keep a < b and c > d in mind", "10 <= n < 20", "5 % of pages mention #4711", "f(x) = x^2 on the board", "-> means x_1 before x_2", "cost $5 at first and $9 later", "a + b = c", "Section [3] of the R&D binder", "x ~ 40 & counting", "C:\\notes\\old\\x and nothing", "In 1990. It began", "word " * 50_000]


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    for text in (PAGES[name][0], PAGES[name][0].replace("\n", "\r\n")):
        found, blocks = M.parse(text)
        counts = {k: sum(b[0] == k for b in blocks) for k in M.KINDS}
        assert found and counts == {k: PAGES[name][1].get(k, 0) for k in M.KINDS}, blocks


def test_leftovers_and_plain_text():
    assert [t for t in LEFTOVERS if not M.parse(t)[0]] == []
    assert [t[:40] for t in PLAIN if M.parse(t)[0]] == []


def test_emphasis_at_the_beginning_of_a_line():
    for text in ("*Where* it ends.\n**Here** it began.\n\n_The_ rest.", "#4711 and #12 are numbers.\n**bold**"):
        found, blocks = M.parse(text)
        assert found and {b[0] for b in blocks} == {"paragraph"}
    assert M.parse("\\section{A b}\nc")[1][0][:3] == ("heading", 1, "A b")


def test_long_texts_end():
    began = time.time()
    for text in ("<!-- " * 3000, "$" * 20_000, "* " * 20_000, "<p>" * 20_000, "`" * 20_000, "[[" * 10_000, "# h\n\n" * 5000, "{" * 20_000):
        M.parse(text)
    assert time.time() - began < 60


def test_structure_and_text(spark):
    rows = [(k, f"/a/{k}.txt", t) for k, (t, _) in PAGES.items()] + [("plain", "/a/p.txt", "just text"), ("null", "/a/n.txt", None), (None, "/a/x", "# h"), ("html", "/b/html.txt", PAGES["html"][0]), ("nopath", None, "# h")]
    df = spark.createDataFrame(rows, "doc_id string, path string, content string").selectExpr("*", "1 AS id", "'x' AS blocks", "'y' AS host")
    out = M.extract(df)
    got = {}
    for r in M.structure(out).collect():
        got.setdefault(r["id"], []).append((r["kind"], r["pos"]))
    assert got.keys() == PAGES.keys() | {"nopath"}
    for k, (_, want) in PAGES.items():
        assert sorted(got[k]) == sorted([("markup", 0), *((kind, i + 1) for kind, n in want.items() for i in range(n))])
    text = {r["id"]: r["text"] for r in M.clean_text(out).collect()}
    assert text["plain"] == "just text" and "null" not in text
    assert text["markdown"].startswith("# A") and "text em and # no" in text["markdown"] and "1. z" in text["markdown"] and "```\n# no" in text["markdown"] and "$x^2$" in text["markdown"]
    assert "<" not in text["html"] and "a b & c" in text["html"] and "# One" in text["html"]
    assert M.structure(M.extract(df.where("false"))).count() == 0


def test_vote_drops_link_containers(spark):
    page = "<div class='nav1'><a href='x'>one link and more</a> <a href='y'>another link here</a></div><div class='text2'><h2>Title {0}</h2><p>words of the page {0}</p></div>"
    rows = [(i, f"http://host/p{i}", page.format(i)) for i in range(5)] + [(9, "http://other/p", "<div class='nav'><a href='x'>only links here</a></div>")]
    df = spark.createDataFrame(rows, "doc_id int, path string, content string")
    won = {(r["host"], r["path"]): r["wins"] for r in M.votes(M.pages(df)).collect()}
    assert won["host", "div.nav"] is False and won["host", "div.text"] is True
    text = {r["id"]: r["text"] for r in M.clean_text(M.extract(df)).collect()}
    assert "link" not in text[1] and "Title 1" in text[1] and "only links" in text[9]


def test_no_length_is_too_long():
    long = "x " * 5000
    for text, kind in ((f"a $${long}$$ b", "formula"), (f"a \\[{long}\\] b", "formula"), (f"a \\({long}\\) b", "formula"), (f"a ${long}y$ b", "formula")):
        found, blocks = M.parse(text)
        assert found and [b[0] for b in blocks if b[0] != "paragraph"] == [kind], text[:9]
    for text in (f"a *{long}y* b", f"a _{long}y_ b", f"a ''{long}y'' b", f"a ~~{long}~~ b", f"a [{long}](u) b", f"a [[{long}]] b", "a {{" + long + "}} b"):
        found, blocks = M.parse(text)
        assert found and not set("*_~[{'") & set(blocks[0][2]), text[:9]
    # an opening sign without its closing one before a blank line is no formula
    assert [b[0] for b in M.parse("costs $$ a\n\nand $$ b")[1]] == ["paragraph"]


@pytest.mark.parametrize("sign", ["[ ", "_a ", "*a ", "{{", "[a](", "\\[ ", "$a ", "\\a[", "<a ", "[[a ", "- ", "= a ", "<pre ", "<div>a", "<ul><li>a", "|-\n| a ", "' '", "\\begin{verbatim} ", "% \n", " "])
def test_linear_time(sign):
    began = time.time()
    M.parse("\\section{x} " + sign * (1_000_000 // len(sign)))
    assert time.time() - began < 20


def test_no_residue():
    text = "\n".join(["{| class=\"x\"", "|-", "! Name !! Size", "|-", "| iron || small", "|}", "", "| a | b |", "|---|:--:|", "| c | d |", "", "> quoted words", "> more", "", "see [the page][ref] here", "", "[ref]: http://x.y", "", "\\maketitle\\centering", "one\\\\", "two {{cite|{{nested}}|y}} three", "", "<o:p>office</o:p>", "", "Fact<ref>cite</ref> and snake_case_name and _it_."])
    found, blocks = M.parse(text)
    whole = "\n".join(b[2] for b in blocks)
    assert found and not re.search(r"[|{}\[\]<>\\]|---|!!|:-|http|maketitle|_it_", whole)
    for words in ("Name Size", "iron small", "a b", "c d", "quoted words\nmore", "see the page here", "two three", "office", "Fact cite and snake_case_name and it."):
        assert re.sub(r"[ \n]+", " ", words) in re.sub(r"[ \n]+", " ", whole), words


def test_levels_and_numbers(spark):
    text = "<ol><li>one<ul><li>inner</li></ul></li><li>two</li></ol>\n\n- a\n  - b\n\n3. c\n\n\\begin{enumerate}\n\\item d\n\\item e\n\\end{enumerate}"
    items = [(b[1], b[5], b[2]) for b in M.parse(text)[1] if b[0] == "list_item"]
    assert items == [(1, "1.", "one"), (2, "-", "inner"), (1, "2.", "two"), (1, "-", "a"), (2, "-", "b"), (1, "3.", "c"), (1, "1.", "d"), (1, "2.", "e")]
    df = spark.createDataFrame([("x", text, "/h/a.md")], "doc_id string, content string, path string")
    assert "1. one\n\n  - inner\n\n2. two\n\n- a" in M.clean_text(M.extract(df)).first()["text"]


def test_a_long_page_has_one_vote(spark, monkeypatch):
    nav = '<div class="nav">' + "".join(f'<a href="u">link {i}</a> ' for i in range(9)) + "</div>"
    pages = [(f"p{i}", f"<div class=body>Words of page {i} that are no link at all.</div>{nav}", f"http://h/{i}") for i in range(4)]
    pages.append(("long", "<div class=body>Some text.</div><div class=nav>" + "many plain words in the wrong place " * 400 + "</div>", "http://h/9"))
    pages += [(f"o{i}", f"<div class=body>Other host {i}.</div>", f"http://o/{i}") for i in range(3)]
    df = spark.createDataFrame(pages, "doc_id string, content string, path string")
    lost = {r["path"] for r in M.votes(M.pages(df)).where("NOT wins").collect()}
    assert lost == {"div.nav"}
    for limit in (8 << 20, 0):  # few lists of lost paths travel, many are met by host
        monkeypatch.setattr(M, "LOST_BYTES", limit)
        got = {r["id"]: r["text"] for r in M.clean_text(M.extract(df)).collect()}
        assert len(got) == 8 and "link" not in got["p1"].replace("no link", "") and got["o1"] == "Other host 1."

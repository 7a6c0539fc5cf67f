import pytest

from lectern.llm import markup

FOUND = [
    ("<p>A <b>bold</b> word</p>", {"html"}), ("x &nbsp; y", {"html"}), ("a<!-- note -->b", {"html"}), ("<pre><code># x\n\\section{y}</code></pre>", {"html"}),
    ("## Head\n\ntext", {"markdown"}), ("see [this](http://a.b/c)", {"markdown"}), ("a **bold** word", {"markdown"}), ("```\n\\begin{x} <b>\n```", {"markdown"}), ("- [ ] task", {"markdown"}), ("> quoted", {"markdown"}), ("a `<b>` b", {"markdown"}), ("[a][1]\n\n[1]: http://x.y", {"markdown"}), ("| a | b |\n|---|:--:|\n| 1 | 2 |", {"markdown"}),
    ("== Head ==", {"wiki"}), ("'''bold''' x", {"wiki"}), ("a [[Link|text]] b", {"wiki"}), ("{{Template|a=1}}", {"wiki"}), ("[http://a.b text here]", {"wiki"}), ('{| class="x"\n|-\n| a\n|}', {"wiki"}), ("__TOC__", {"wiki"}), ("x [[Category:A]]", {"wiki"}),
    ("\\section{A}", {"latex"}), ("a $x^2$ b", {"latex"}), ("\\begin{verbatim}\n# x\n**y**\n\\end{verbatim}", {"latex"}), ("\\[ x = 1 \\]", {"latex"}), ("\\textbf{a} b", {"latex"}), ("a~\\cite{b}", {"latex"}),
    ("* [[A b]]\n** Item of a list", {"wiki"}), ("Text above\n~~~\n# x\n~~~", {"markdown"}), ("* Head\n** Sub", {"org"}),
    ("#+TITLE: x", {"org"}), ("** TODO x", {"org"}), ("[[file:a.org][text]]", {"org"}), ("#+begin_src c\n.. note:: x\n#+end_src", {"org"}), (":PROPERTIES:\n:ID: 1\n:END:", {"org"}), ("a @@latex:x@@ b", {"org"}),
    (".. note:: x", {"rst"}), (".. code-block:: c\n\n   ## x\n   \\section{y}\n", {"rst"}), ("a :ref:`b` c", {"rst"}), ("`a <http://b.c>`_", {"rst"}), ("Title\n~~~~~", {"rst"}), (".. _a-1:", {"rst"}), ("``x``", {"rst"}),
]
PLAIN = [
    "62 | 62 | 62", "\\o/ done", "<3 <3", "e.g. **** out of *****", "100% of 34%", "Mail <anna@a.example> about it.", "(^_^)", "a -> b => c", "See C:\\temp\\new\\x for logs.", "5 < 7 > 3 is odd.",
    "2^10 and 3_4", "C# & F# & AT&T-like names", "[sic] and [1] stay.", "Lunch costs $5 and supper $7.", "R&D says x == y.", "If a < b and c > d, keep both.", "cost = 4 = total", "---", "-- x", "Fill in {this} by hand.",
    "It takes 5 * 3 * 2 minutes.", "'' and `` are marks", "The name is a_b_total.", "-----------------", "_______________", "Rate: ~9 of ~9.", "The prize goes to #98 and #98.", "", "  ", "«Das kleine Werkzeug»",
]


@pytest.mark.parametrize("text, kinds", FOUND)
def test_found(text, kinds):
    assert markup.kinds_of(f"Some text here.\n\n{text}\n\nMore text.") == kinds


@pytest.mark.parametrize("text", PLAIN)
def test_plain(text):
    assert markup.kinds_of(f"Some text here.\n\n{text}\n\nMore text.") == set()


def test_clean():
    text = "<h2>Head</h2>\n\nA **bold** [link](http://x.y) &amp; more.\n\n```c\n<b>\n```\n\n* [[Item]]\n\nWith $x^2$ and \\emph{this}~\\cite{k}.\n"
    assert markup.clean(text) == "## Head\n\nA bold link & more.\n\n```\n<b>\n```\n\n- Item\n\nWith $x^2$ and this."
    assert markup.clean("** TODO Head\n:PROPERTIES:\n:ID: 1\n:END:\n\nText [[file:a.org][here]].", "org") == "## Head\n\nText here."
    assert markup.clean("\\section{Head}\n\n\\begin{itemize}\n  \\item One\n\\end{itemize}", "latex") == "## Head\n\n- One"
    assert markup.clean("") == "" and markup.clean("Plain text.") == "Plain text."


def test_rows(spark):
    rows = [(1, "x <b>y</b>", "md"), (1, "x <b>y</b>", "md"), (2, None, "org"), (3, "", None), (4, "# A\n\n\\section{b}", "Markdown"), (5, "# A", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "call_id bigint, text string, format string, markup int")
    assert sorted(tuple(r) for r in markup.residue(df).collect()) == [(1, "html"), (4, "latex"), (5, "markdown")]
    assert {r.call_id: r.clean for r in markup.clean_texts(df).collect()}[2] is None
    assert markup.residue(df.limit(0)).count() == 0


def test_unclosed_marks_are_read_once():
    assert markup.kinds_of("<!-- a \\( b $$ c\n" * 20_000) <= {"html", "latex"}


def test_very_long():
    text = ("word [a](b) <i>x</i> $y_1$ `z` \\emph{q}\n" * 20_000) + "*" * 5000 + "[" * 5000 + "$" * 3000 + "`" * 3000 + "<" * 3000
    assert markup.kinds_of(text) >= {"html", "markdown", "latex"}

"""Page text on hand-made pages, and chat formatting read back."""

import hashlib
import itertools
from collections import Counter

import pytest

from fadegraph.llm import chat, html_text

BODY = ("<h1>Title &amp; more</h1><p>First, a longer paragraph of text; it has points.<br>And a <b>second</b> line.</p>"
        "<p>Another, with a <a href='/x'>link</a>, ends here.")
TEXT = "Title & more First, a longer paragraph of text; it has points. And a second line. Another, with a link, ends here."
AROUND = [
    "<nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News, all</a></li></ul></nav>", "<header><h2>Site name, the best.</h2></header>",
    "<div class=\"ad\">Buy this, now. It is good, cheap, and near.</div>", "<aside><p>See also: this, that, and more.</p></aside>",
    "<div id='cookie-notice'><p>We use cookies, as all do.</p></div>", "<form><p>Your name, please.</p><input name=a></form>",
    "<script>var t = '</p><p>no, no.</p>';</script><style>p{margin:0}</style>", "<!-- <p>hidden, too.</p> -->",
    "<footer>&copy; someone, 2020. All rights.</footer>", "<section class='comments'><p>I, a reader, object. Strongly, even.</p></section>",
]


@pytest.mark.parametrize("holder", ["article", "main", "div", "div class='content'"])
def test_article_among_the_rest(holder):
    tag = holder.split()[0]
    page = (f"<!DOCTYPE html><html><head><title>T, t.</title></head><body>{''.join(AROUND[:5])}<{holder}>{BODY}</{tag}>"
            f"{''.join(AROUND[5:])}</body></html>")
    assert html_text.main_text(page) == TEXT


def test_broken_and_odd_pages():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>a</nav>") == ""
    assert html_text.main_text("plain text, no tags") == "plain text, no tags"
    assert html_text.main_text("<p>a < b &lt; c") == "a < b < c"
    assert html_text.main_text("<article><p><b>One.<br><p>Two\n\n three</article>") == "One. Two three"
    assert html_text.main_text("<p>x</p><script>never closed <p>y</p>") == "x"
    assert html_text.main_text("<article><p>cut off here <a href=\"x") == "cut off here"
    long = "<article>" + "".join(f"<p>Word {i}, end.</p>" for i in range(20_000)) + "</article>"
    assert html_text.main_text(long) == " ".join(f"Word {i}, end." for i in range(20_000))


def test_pages_as_a_table(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", f"<article>{BODY}</article>", "clash", 9), (1, "u", f"<article>{BODY}</article>", "clash", 9),
            (2, None, None, None, None), (None, "v", "", None, None)]
    got = Counter(map(tuple, html_text.extract_text(spark.createDataFrame(rows, schema)).collect()))
    assert got == Counter({(1, "u", TEXT, len(TEXT)): 2, (2, None, "", 0): 1, (None, "v", "", 0): 1})
    assert html_text.extract_text(spark.createDataFrame([], schema)).collect() == []


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST] <|end|> &l &a"), (1, 2, "user", None), (1, 3, "assistant", "b\n"),
    (1, 4, "user", "tail"), (2, 0, "system", "only"), (3, None, None, "<|x|>"), (3, 2, "assistant", ""), (3, 2, "assistant", "again"),
    (3, 2, "assistant", "again"), (4, 1, "as|>s<|[&", "role"), (None, 0, "assistant", "no id"), (5, 0, "user", "z" * 50_000),
    (5, 1, "assistant", "é😀" * 20_000),
] + [(6, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(120)]
SCHEMA = "conv_id long, turn long, role string, text string, example int, formatted string"


def test_chat_reads_back(spark):
    table = spark.createDataFrame([(*t, 1, "clash") for t in TURNS], SCHEMA).repartition(4)
    examples = chat.format_chat(table)
    found = {r.conv_id: r for r in chat.read_back(examples).collect()}
    key = lambda t: (t[1] is None, t[1] or 0, t[2] or "", t[3] or "")
    sizes = Counter()
    for r in examples.collect():
        sizes[r.conv_id] += len(r.formatted)
        if r.trainable:
            assert r.formatted[r.loss_end:] == chat.END and 0 <= r.loss_start <= r.loss_end
        else:
            assert r.loss_start == r.loss_end
    for conv, own in itertools.groupby(sorted(TURNS, key=lambda t: (t[0] is None, t[0] or 0)), key=lambda t: t[0]):
        own = sorted(own, key=key)
        body = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        r = found.pop(conv)
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(body.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sizes[conv]
    assert not found
    assert chat.format_chat(table.limit(0)).collect() == []


def test_an_example_for_each_reply(spark):
    table = spark.createDataFrame([(*t, 1, "") for t in TURNS], SCHEMA)
    rows = chat.format_chat(table).filter("conv_id = 1").orderBy("example").collect()
    assert [(r.example, r.trainable) for r in rows] == [(2, True), (4, True), (5, False)]
    assert rows[1].formatted.startswith(rows[0].formatted)
    assert all(s not in rows[2].formatted.replace(chat.END, "") for s in ("[INST]", "</s>", "<|end"))


def test_chat_runs_no_python(spark):
    plan = chat.read_back(chat.format_chat(spark.createDataFrame([], SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

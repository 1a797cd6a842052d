"""Pages by a plain model of the method, and pages on which articles or their parts were once lost."""

import math
import random
import re
import time

import pytest

from fadegraph.llm import html_text

SIX = [f"Paragraph {i} of the article has about ninety-five characters of text, with one comma and a stop at its end."
       for i in range(6)]
BODY = "".join(f"<p>{x}</p>" for x in SIX)
WANT = " ".join(SIX)


def test_values_of_other_attributes_say_nothing():
    for holder in ("<div title='A hidden gem'>", "<div data-hidden='false'>", "<div data-class='ad'>", "<div title=\"class=ad hidden\">",
                   "<div data-style='display:none'>", "<article aria-label='hidden'>"):
        assert html_text.main_text(f"<body>{holder}{BODY}</{holder[1:].split()[0]}></body>") == WANT
    assert html_text.main_text(f"<article>{BODY}<p title='the hidden cost'>One more, at the end.</p></article>") == f"{WANT} One more, at the end."
    for holder in ("<div hidden>", "<div class=x hidden=''>", "<div STYLE='color:red; display : none'>", "<div id='x' aria-hidden=true>"):
        assert html_text.main_text(f"<body>{holder}<p>Not, shown; at all.</p></div><article>{BODY}</article></body>") == WANT


def test_an_advert_with_more_commas_does_not_win():
    advert = "<div class='x9'><p>Buy, now, here, cheap, good, fast, near, new, old, red, blue, green, big, small, all, of, it!</p></div>"
    for page in (f"<body>{advert}<article>{BODY}</article></body>", f"<body><article>{BODY}</article>{advert}</body>",
                 f"<body>{advert}<main>{BODY}</main>{advert}</body>"):
        assert html_text.main_text(page) == WANT
    assert WANT in html_text.main_text(f"<body>{advert}<section>{BODY}</section></body>")


@pytest.mark.parametrize("part", [
    "<div>The end.</div>", "<div class='lead'>In short.</div>", "<blockquote><div>So they said</div></blockquote>",
    "<div class='x1'><table><tr><td>one</td><td>two</td></tr></table></div>", "<div class='x2'><pre>a = 1</pre></div>",
    "<ul><li><a href='/a'>First source</a></li><li><a href='/b'>Second source</a></li></ul>", "<div><div>Deep</div></div>",
    "<div class='post-content'><p>Short</p></div>", "<dl><dt>Term<dd>Meaning</dl>", "<section><h2>Head</h2><p>Few words</p></section>"])
def test_parts_of_a_marked_article_stay(part):
    words = " ".join(re.sub("<[^>]*>", " ", part).split())
    for page, want in ((f"<article>{BODY}{part}</article>", f"{WANT} {words}"), (f"<main>{part}{BODY}</main>", f"{words} {WANT}")):
        assert html_text.main_text(f"<body><nav><a href='/'>Home</a></nav>{page}<div class='x7'>Terms, of use.</div></body>") == want


def test_inline_elements_keep_their_words():
    assert html_text.main_text(f"<article>{BODY}<p>One <span class='search'>word</span> <b class='alert'>more</b>, at <i class=ad>last</i>.</p>"
                               "</article>") == f"{WANT} One word more, at last."
    assert html_text.main_text(f"<article>{BODY}<p>Seen<span hidden> not <b>seen</b></span>, again.</p></article>") == f"{WANT} Seen, again."


@pytest.mark.parametrize("page,size", [
    ("<div>some text, here. " * 230_000, 230_000), ("<div>" * 500_000 + "x", 0), ("<div class=ad><p>x " * 60_000, 0),
    ("<ul><li>a " * 100_000, 0), ("<table><tr><td>x" * 60_000, 0), ("<a title=\"" * 200_000, 0), ("<article><main>y" * 60_000, 0)])
def test_deep_and_broken_pages_take_time_by_their_length(page, size):
    start = time.process_time()
    text = html_text.main_text(page)
    assert time.process_time() - start < 20  # some 5 s for 5 MB
    assert not size or text == " ".join(["some text, here."] * size)


def plain(tree):
    """The model: a tree of (tag, class, children or text) by the sentences of the module, without numbers or shortcuts."""
    blocks = []

    def walk(node, way):
        tag, name, inside = node
        if name == "ad":
            return
        here = way + ((tag, name, id(node)),)
        if isinstance(inside, str):
            blocks.append((inside, here))
        else:
            for child in inside:
                walk(child, here)

    walk(tree, ())
    if not blocks:
        return ""

    def path(way):
        return tuple(tag for tag, _, _ in way)

    def weight(length, points):
        return math.log(1 + length) * (1 + math.log(1 + points))

    def points(text):
        return sum(text.count(c) for c in ".,;:!?")

    paths = {path(way) for _, way in blocks}
    of = {p: [t for t, way in blocks if path(way) == p] for p in paths}
    lengths = [sum(map(len, of[path(w)])) / len(of[path(w)]) for _, w in blocks]
    marks = [sum(map(points, of[path(w)])) / len(of[path(w)]) for _, w in blocks]

    def smooth(v, i):
        return v[max(i - 1, 0)] / 4 + v[i] / 2 + v[min(i + 1, len(v) - 1)] / 4

    weights = {p: sum(weight(smooth(lengths, i), smooth(marks, i)) for i, (_, w) in enumerate(blocks) if path(w) == p) / len(of[p]) for p in paths}
    sizes = {p: sum(map(len, of[p])) for p in paths}
    mean = sum(weights[p] * sizes[p] for p in paths) / sum(sizes.values())
    spread = math.sqrt(sum(sizes[p] * (weights[p] - mean) ** 2 for p in paths) / sum(sizes.values()))
    threshold = min(max(mean, spread), max((sizes[p], weights[p]) for p in paths)[1])
    chosen = {p for p in paths if weights[p] >= threshold}
    inside = [(t, w) for t, w in blocks if "article" in path(w)]
    article = "article" if inside else None
    if article:
        own = {}
        for t, w in inside:
            own[path(w)] = own.get(path(w), 0) + len(t)
        chosen.add(max(own, key=own.get))
    holder = next((i for i, e in enumerate(inside[0][1]) if e[0] == "article"), None) if article else None
    if not article:
        ways = [w for _, w in blocks if path(w) in chosen]
        holder = 0
        while holder + 1 < min(map(len, ways)) and len({w[holder + 1] for w in ways}) == 1:
            holder += 1
        while ways[0][holder][0] in html_text.PARTS:
            holder -= 1
        inside = [(t, w) for t, w in blocks if len(w) > holder and w[holder] == ways[0][holder]]
    bounded = inside[0][1][holder][0] != "body"
    around = {e for t, w in inside if path(w) in chosen for e in w}
    out, follows = [], False
    for text, way in reversed(inside):
        heading = any(tag in html_text.HEADINGS for tag, _, _ in way)
        text_like = all(e in around or e[0] in html_text.PARTS or (bounded and e[1] == "") for e in way[holder + 1:])
        given = (path(way) in chosen or text_like or weight(len(text), points(text)) >= 0.75 * threshold
                 or any(tag in html_text.SOLID for tag, _, _ in way) or (heading and (follows or "h1" in path(way))))
        if given:
            out.append(text)
        if given or not heading:
            follows = given
    return " ".join(reversed(out))


def grown(rng, depth=0):
    """Elements of a page, nested at random; texts of different weight."""
    out = []
    for _ in range(rng.randrange(1, 6)):
        kind = rng.random()
        name = rng.choice(["", "", "x1", "x2", "ad"])
        if kind < 0.35 and depth < 3:
            out.append((rng.choice(["div", "div", "section", "blockquote"]), name, grown(rng, depth + 1)))
        else:
            words = " ".join(rng.choice(["word", "other,", "third", "end."]) for _ in range(rng.choice([1, 2, 4, 30])))
            out.append((rng.choice(["p", "p", "div", "h2", "h1", "pre"]), name, words))
    return out


def of_ads(node, ad=False):
    ad = ad or node[1] == "ad"
    if isinstance(node[2], str):
        yield len(node[2]), ad
    else:
        for child in node[2]:
            yield from of_ads(child, ad)


def written(node):
    tag, name, inside = node
    body = inside if isinstance(inside, str) else "".join(map(written, inside))
    return f"<{tag}{f' class={name}' if name else ''}>{body}</{tag}>"


@pytest.mark.parametrize("seed", range(150))
def test_pages_like_the_model(seed):
    rng = random.Random(seed)
    inner = grown(rng)
    if seed % 2:
        inner = grown(rng) + [("article", "", inner)] + grown(rng)
    tree = ("body", "", inner)
    texts = list(of_ads(tree))
    if seed % 2 or sum(n for n, ad in texts if not ad) >= 0.1 * sum(n for n, _ in texts):  # else an advert may be the article
        assert html_text.main_text(written(tree)) == plain(tree)

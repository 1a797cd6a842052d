"""Pages of which nothing that belongs to the article may be lost."""

from fadegraph.llm import html_text

ITEMS = [f"Item {i}, which has some words of its own, and so is as long as a line." for i in range(30)]


def test_no_chosen_block_is_outside():
    listed = "".join(f"<li>{x}</li>" for x in ITEMS)
    lead = "A lead, with words: enough for a line, and more than that; it ends here, at last, and so on."
    page = f"<body><article><h1>T</h1><p>{lead}</p><ol>{listed}</ol></article></body>"
    assert html_text.main_text(page) == " ".join(["T", lead, *ITEMS])
    page = f"<body><article><h1>T</h1><p>{lead}</p><div class=body>{' '.join(ITEMS)}</div><p>The end.</p></article></body>"
    assert html_text.main_text(page) == " ".join(["T", lead, *ITEMS, "The end."])
    page = f"<body><div><p>{lead}</p></div><div><p>{'</p><p>'.join(ITEMS)}</p></div></body>"
    assert html_text.main_text(page) == " ".join([lead, *ITEMS])


def test_paths_decide():
    texts = [f"A paragraph {i}, of some words; and more of them, so that it is long enough." for i in range(9)]
    body = "".join(f"<p>{x}</p>" for x in texts)
    want = " ".join(texts)
    advert = "<div class='c7'>Buy now</div>"
    for holder in ("article", "main", "body"):
        end = "" if holder == "body" else f"</{holder}>"
        start = "<body>" if holder == "body" else f"<body><{holder}>"
        assert html_text.main_text(f"{start}{advert}{body}{advert}<div class='c8'><h3>Offer</h3><p>Only now.</p></div>{end}") == want
    # Headings, short items and weighty blocks of other holders stay.
    other = "A note in a box of its own, which is shorter, but a sentence or two. It stays."
    page = (f"<article><header><h1>T</h1><span>By X</span></header>{body}<section><h2>More</h2><p>Short.</p><ul><li>one<li>two</ul></section>"
            f"<div class='c9'>{other}</div></article>")
    assert html_text.main_text(page) == f"T By X {want} More Short. one two {other}"


def test_wrappers_around_the_article():
    body = "".join(f"<p>{x}</p>" for x in ITEMS)
    want = " ".join(ITEMS)
    for name in ("page has-sidebar", "layout no-sidebar", "post-content widget", "comments-open"):
        assert html_text.main_text(f"<body><div class='{name}'><article>{body}</article></div></body>") == want
    for name in ("page has-sidebar", "layout no-sidebar", "comments-open"):
        assert html_text.main_text(f"<body><div class='{name}'><div>{body}</div></div></body>") == want
    assert html_text.main_text(f"<body><form id=f>{body}<input name=a></form></body>") == want
    assert html_text.main_text(f"<body><form id=f><div class=ad>Buy, now.</div><main>{body}</main></form></body>") == want
    # What is no wrapper of the article stays aside.
    comment = "<ol class='comment-list'><li><article><p>I, a reader, object. Strongly, even.</p></article></ol>"
    for name in ("ad", "site-footer", "cookie-notice", "left_sidebar", "sidebar-2", "widget3", "x related"):
        rest = f"<div class='{name}'><p>See also: this, that, and much more, of all that there is.</p></div>"
        assert html_text.main_text(f"<body>{rest}<article>{body}</article>{comment}{rest}</body>") == want
        assert html_text.main_text(f"<body>{rest}<div>{body}</div>{rest}</body>") == want
    assert html_text.main_text(f"<body><div hidden><p>{want}</p></div><p>Shown.</p></body>") == "Shown."
    consent = f"<div class='cookie'>{want}</div>"
    assert html_text.main_text(f"<body>{consent}<p>{ITEMS[0] * 9}</p></body>") == ITEMS[0] * 9


def test_raw_elements_that_close_themselves():
    for icon in ("<svg class='i'/>", "<svg/>", "<svg data-x='a>b' />", "<math />", "<svg class='i'><path d='M0'/><text>no</text></svg>"):
        assert html_text.main_text(f"<article>{icon}<p>one</p><p>two</p></article>") == "one two"
        assert html_text.main_text(f"<article>{icon}<p>one</p><p>two</p><svg>no</svg></article>") == "one two"
    page = "<head><script src='a'/><title/></head><body><article><p>one</p><iframe src='b' /><p>two</p></article><script>no</script></body></html>"
    for start in ("<?xml version='1.0'?><html>", '<html xmlns="http://www.w3.org/1999/xhtml">', "<!DOCTYPE html><html lang='en' xmlns='http://www.w3.org/1999/xhtml'>",
                  '<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Strict//EN" "http://www.w3.org/TR/xhtml1/DTD/xhtml1-strict.dtd"><html>'):
        assert html_text.main_text(start + page) == "one two"
    # HTML does not know this of a script.
    assert html_text.main_text("<article><p>one</p><script src='a'/>no</script><p>two</p></article>") == "one two"

"""Pages whose class names, ids or short blocks say little about what is main text."""

from tesserae.llm import html

SAID = "The results of the survey show what people do with the files they get, and why they pass them on to others."
LONG = f"<p>{SAID}</p>"


def test_slugs_and_states_are_not_names():
    page = f'<article class="post has-comments"><h2 id="how-to-share-files">How to share files</h2>{LONG}<section id="social-impact"><h3>Impact</h3>{LONG}</section><section id="discussion">{LONG}</section></article>'
    assert html.main_text(page) == f"How to share files\n{SAID}\nImpact\n{SAID}\n{SAID}"
    assert html.main_text(f'<article class="post comments-open">{LONG}</article>') == SAID
    assert html.main_text(f'<article class="discussion">{LONG}</article>') == SAID


def test_everyday_words_are_weighed():
    for name in ("legal", "social", "search", "discussion", "related"):
        assert html.main_text(f'<article>{LONG}<div class="{name}">{LONG}</div>{LONG}</article>').count(SAID) == 3, name
        links = '<ul><li><a href="/a">First page</a><li><a href="/b">Second page</a></ul>'
        assert html.main_text(f'<article>{LONG}<div class="{name}">{links}</div>{LONG}</article>').count("page") == 0, name
    assert html.main_text(f'<article>{LONG}<div class="share-bar">Share this</div></article>') == SAID


def test_reader_comments_stay_out():
    for c in ('<div class="comments">', '<section id="comments">', '<ol class="comment-list"><li class="comment"><article class="comment-body">', '<div id="disqus_thread">'):
        assert html.main_text(f"<main><article><p>{SAID} Yes.</p></article>{c}{LONG}") == f"{SAID} Yes.", c
    assert html.main_text(f'<article>{LONG}</article><footer><div class="legal">{LONG}</div></footer>') == SAID


def test_short_blocks_go_with_their_neighbours():
    links = '<div><ul><li><a href="/">Home</a><li><a href="/n">News</a></ul></div>'
    lists = f"{LONG}<ul><li>Flour<li>Two eggs</ul><h4>Method</h4>{LONG}<table><tr><th>Oven<td>180 degrees<tr><th>Time<td>1 hour</table><dl><dt>Serves<dd>Four</dl>{LONG}"
    want = f"{SAID}\nFlour\nTwo eggs\nMethod\n{SAID}\nOven\n180 degrees\nTime\n1 hour\nServes\nFour\n{SAID}"
    assert html.main_text(f"<body>{links}<div id=page>{lists}</div>{links}</body>") == want
    assert html.main_text(f"<body>{links}<div id=page>{LONG}<ul><li>Flour<li>Two eggs</ul></div>{links}</body>") == f"{SAID}\nFlour\nTwo eggs"
    many = "".join(f"<tr><td>{i}<td>x" for i in range(3000))
    assert html.main_text(f"<body>{links}<div>{LONG}<table>{many}</table>{LONG}</div></body>").count("\n") == 6001


def test_short_blocks_among_boilerplate_stay_out():
    items = "<ul><li>Flour<li>Two eggs</ul>"
    assert html.main_text(f"<body><div><div>{items}</div></div><nav>x</nav></body>") == ""
    assert html.main_text(f"<body><div id=page>{LONG}</div><div class=sidebar>{items}</div><footer>{items}</footer></body>") == SAID
    side = '<p><a href="/a">One of the links</a></p>'
    assert html.main_text(f"<body><div><div>{LONG}{LONG}</div></div>{side}<div><div>{side}{items}{side}</div></div></body>") == f"{SAID}\n{SAID}"


def test_formulas_and_fallbacks_are_text():
    page = '<article><p>Here is <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <object>a figure</object> and <canvas>a drawing</canvas>.</p>'
    assert html.main_text(page) == "Here is x=2 and a figure and a drawing."
    for open_ in ("<math/>", "<object>", "<canvas>", "<select>", "<template>", "<svg>", "<noscript>"):
        assert html.main_text(f"<article>{LONG}{open_}{LONG}") == f"{SAID}\n{SAID}", open_
    assert html.main_text(f"<article>{LONG}<textarea>{LONG}") == SAID

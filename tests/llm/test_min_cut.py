"""The minimum cut on made pages with known truth: fitted costs, held-out F1, labels that neighbours turn."""

import time

import numpy as np

import made_pages
from tesserae.llm import html

P = "long words stand here in a row so that this is a text of an article and no menu at all, is it."


def test_weights_are_the_fitted_ones():
    fitted = html.fit_costs(made_pages.labelled(html, range(600)))
    assert np.allclose(fitted, html.WEIGHTS, atol=0.02)


def test_cut_is_better_than_thresholds_on_held_out_pages():
    held = made_pages.labelled(html, range(10_000, 10_300))
    bare = made_pages.labelled(html, range(20_000, 20_200), named=False, semantic=False)
    c = html.Costs()
    assert made_pages.f1(html, held, c) > max(0.975, made_pages.f1(html, held, c, cut=False))
    assert made_pages.f1(html, bare, c) > max(0.96, made_pages.f1(html, bare, c, cut=False))


def test_cut_turns_labels_both_ways_without_any_name():
    turned, pages = {True: 0, False: 0}, 0
    bare = made_pages.labelled(html, range(20_000, 20_200), named=False, semantic=False)
    for blocks, _ in bare:
        scores = html.scores_of(blocks, html.Costs())
        new = [now for now, s in zip(html.label(blocks), scores, strict=True) if now != (s > 0)]
        pages += bool(new)
        for now in new:
            turned[now] += 1
    assert turned[True] > 5 and turned[False] > 5 and pages > 0.03 * len(bare), (turned, pages)


def test_names_inside_an_article_are_no_veto():
    page = (
        f'<body><nav><a href=x>Home</a></nav><article><div class="post-header"><h1>Title of it</h1></div><p>{P}</p><section id="discussion"><h2>Discussion</h2><p>{P} two</p></section>'
        f'<div class="social-history"><p>{P} three</p></div><p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><div class="menu-of-the-day"><p>Soup and bread {P}</p></div></article><footer>c</footer></body>'
    )
    assert html.main_text(page).split("\n") == ["Title of it", P, "Discussion", f"{P} two", f"{P} three", "where x=2 holds", f"Soup and bread {P}"]


def test_deep_and_long_pages_take_linear_time():
    began = time.time()
    deep = "".join(f"<div><p>{P}" for _ in range(4000))
    assert html.main_text(f"<body><article>{deep}</article></body>").count("\n") == 3999
    wide = "".join(f"<div><p>{P}</p></div>" for _ in range(20_000))
    assert html.main_text(f"<body><article>{wide}</article></body>").count("\n") == 19_999
    assert time.time() - began < 30

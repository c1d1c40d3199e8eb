"""Pages made from templates, each text block with its truth: part of the article or not."""

import random

OUT = ("nav", "site-header", "footer", "sidebar", "cookie", "ad", "related", "share", "newsletter", "comments")


class Maker:
    """One page per seed. ``named`` and ``semantic`` say whether class names and semantic elements may be there."""

    def __init__(self, seed, named=None, semantic=None):
        self.r = random.Random(seed)
        self.named = self.r.random() < 0.6 if named is None else named
        self.semantic = self.r.random() < 0.5 if semantic is None else semantic
        self.truth = {}
        self.n = 0

    def word(self):
        return "".join(self.r.choice(("ta", "re", "mi", "so", "lu", "an", "ter", "is", "o", "en")) for _ in range(self.r.randrange(1, 4)))

    def said(self, low, high, keep, end=True):
        """Words with a mark of their own, so that the block can be found again."""
        self.n += 1
        mark = f"q{self.n}q"
        self.truth[mark] = keep
        words = [mark, *(self.word() for _ in range(self.r.randrange(low, high) - 1))]
        return " ".join(words).capitalize() + ("." if end and self.r.random() < 0.9 else "")

    def attr(self, *names):
        if self.named and names:
            return f' class="{self.r.choice(names)}"'
        return f' class="css-{self.r.randrange(10**5)}"' if self.r.random() < 0.3 else ""

    def tag(self, name):
        return name if self.semantic else "div"

    def plain(self, n):
        """Items without links beside the article: hours, addresses, counters."""
        return f"<ul>{''.join(f'<li>{self.said(1, 6, False, False)}</li>' for _ in range(n))}</ul>"

    def links(self, n, keep=False):
        if not keep and self.r.random() < 0.25:
            return self.plain(n)
        items = "".join(f'<li><a href="/{i}">{self.said(1, 5, keep, False)}</a></li>' for i in range(n))
        return f"<ul>{items}</ul>"

    def outside(self, kind):
        r = self.r
        if kind == "nav":
            t = self.tag("nav")
            return f"<{t}{self.attr('navbar', 'main-menu', 'nav')}>{self.links(r.randrange(3, 9))}</{t}>"
        if kind == "site-header":
            t = self.tag("header")
            name = self.said(1, 4, False, False)
            name = f"<h1>{name}</h1>" if r.random() < 0.3 else f"<a href='/'>{name}</a>"
            return f"<{t}{self.attr('site-header', 'page-header', 'masthead', 'topbar')}>{name}<p>{self.said(3, 9, False)}</p></{t}>"
        if kind == "footer":
            t = self.tag("footer")
            return f"<{t}{self.attr('footer', 'site-footer')}><p>&copy; {self.said(3, 25, False)}</p>{self.links(r.randrange(0, 4))}<h4>{self.said(1, 4, False, False)}</h4></{t}>"
        if kind == "sidebar":
            t = self.tag("aside")
            text = f"<p>{self.said(5, 25, False)}</p>" if r.random() < 0.5 else ""
            return f"<{t}{self.attr('sidebar', 'widget')}><h3>{self.said(1, 4, False, False)}</h3>{text}{self.links(r.randrange(2, 7))}</{t}>"
        if kind == "cookie":
            return f"<div{self.attr('cookie-notice', 'consent', 'gdpr-banner')}><p>{self.said(8, 25, False)}</p><button>{self.said(1, 3, False, False)}</button></div>"
        if kind == "ad":
            text = self.said(4, 20, False)
            text = f"<p>{text}</p>" if r.random() < 0.5 else text
            return f"<div{self.attr('ad', 'advert', 'sponsored', 'promo')}>{text}</div>"
        if kind == "related":
            return f"<div{self.attr('related', 'recommended', 'trending')}><h4>{self.said(1, 4, False, False)}</h4>{self.links(r.randrange(2, 6))}</div>"
        if kind == "share":
            return f"<div{self.attr('share', 'social-buttons', 'sharing')}><span>{self.said(1, 3, False, False)}</span> <a href='#'>{self.word()}</a></div>"
        if kind == "newsletter":
            form = f"<form><label>{self.said(1, 3, False, False)}</label></form>"
            return f"<div{self.attr('newsletter', 'signup', 'subscribe')}><p>{self.said(5, 16, False)}</p>{form}</div>"
        items = "".join(f"<li><p>{self.said(3, 30, False)}</p></li>" for _ in range(r.randrange(1, 5)))
        # Readers' words cannot be told from an author's without any name.
        name = r.choice(("comments", "comment-list"))
        return f'<div class="{name}"><h3>{self.said(1, 3, False, False)}</h3><ol>{items}</ol></div>'

    def inside(self):
        r, kind = self.r, self.r.random()
        if kind < 0.55:
            link = f' <a href="/x">{self.word()}</a> {self.word()}' if r.random() < 0.3 else ""
            return f"<p>{self.said(8, 90, True)}{link}</p>"
        if kind < 0.62:
            return f"<p>{self.said(2, 8, True)}</p>"
        if kind < 0.74:
            h = r.choice(("h2", "h3", "h4"))
            return f"<{h}>{self.said(1, 7, True, False)}</{h}><p>{self.said(10, 60, True)}</p>"
        if kind < 0.84:
            t = r.choice(("ul", "ol"))
            return f"<{t}>{''.join(f'<li>{self.said(1, 12, True, False)}</li>' for _ in range(r.randrange(2, 6)))}</{t}>"
        if kind < 0.89:
            rows = "".join(f"<tr><td>{self.said(1, 4, True, False)}</td><td>{self.said(1, 4, True, False)}</td></tr>" for _ in range(r.randrange(2, 5)))
            return f"<table>{rows}</table>"
        if kind < 0.93:
            return f"<blockquote>{self.said(5, 40, True)}</blockquote>"
        # An author's own use of everyday words.
        name = r.choice(("social-history", "legal", "discussion", "search-methods", "menu-of-the-day", "notice-board")) if self.named else ""
        named = f' class="{name}"' if name and r.random() < 0.7 else ""
        return f"<div{named}><p>{self.said(8, 50, True)}</p></div>"

    def page(self):
        r = self.r
        title = f"<h1>{self.said(2, 10, True, False)}</h1>"
        if r.random() < 0.4:
            title = f"<div{self.attr('post-header', 'entry-header', 'article-header')}>{title}</div>"
        parts = [title, *(self.inside() for _ in range(r.randrange(1, 12)))]
        if r.random() < 0.3:
            cut = r.randrange(1, len(parts) + 1)
            parts = [*parts[:cut], f"<section>{''.join(parts[cut:])}</section>"]
        for kind in ("ad", "share", "related", "newsletter"):
            if r.random() < 0.2:
                parts.insert(r.randrange(1, len(parts) + 1), self.outside(kind))
        t = r.choice(("article", "main")) if self.semantic else "div"
        article = f"<{t}{self.attr('content', 'post', 'entry', 'story')}>{''.join(parts)}</{t}>"
        before = [self.outside(k) for k in ("nav", "site-header", "cookie", "ad") if r.random() < 0.6]
        after = [self.outside(k) for k in ("sidebar", "related", "newsletter", "footer", "cookie", "ad") if r.random() < 0.5]
        if r.random() < 0.35:
            after.insert(0, self.outside("comments"))
        if r.random() < 0.06:
            # A page without main text.
            article = f"<div><div>{self.plain(r.randrange(1, 4))}</div></div>"
        elif r.random() < 0.5:
            article = f"<div><div>{article}</div></div>"
        return f"<html><body>{''.join(before)}{article}{''.join(after)}</body></html>", self.truth


def labelled(html, seeds, **how):
    """(blocks, truth) of the pages of ``seeds``; blocks without a mark are left out of the truth (None)."""
    import re

    out = []
    for s in seeds:
        page, truth = Maker(s, **how).page()
        blocks = html.blocks_of(page)
        marks = [re.search(r"q\d+q", b.text, re.I) for b in blocks]
        out.append((blocks, [truth[m[0].lower()] if m else None for m in marks]))
    return out


def f1(html, pages, costs, cut=True):
    """F1 of content blocks, with the minimum cut or by the sign of each block's score alone."""
    hit = wrong = missed = 0
    for blocks, truth in pages:
        got = html.label(blocks, costs) if cut else [x > 0 for x in html.scores_of(blocks, costs)]
        for g, t in zip(got, truth, strict=True):
            if t is not None:
                hit, wrong, missed = hit + (g and t), wrong + (g and not t), missed + (t and not g)
    return 2 * hit / max(1, 2 * hit + wrong + missed)

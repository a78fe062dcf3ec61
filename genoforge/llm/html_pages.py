"""Labelled web pages for training: random layouts whose article is known by construction.

Nodes of the article carry the attribute KNOWN, which the feature extractor never sees.
"""

from __future__ import annotations

import random
from collections.abc import Callable

KNOWN = "data-known"

# Names that page templates usually give to their parts.
ARTICLE_NAMES = ["article", "article-body", "content", "entry-content", "main-content", "post", "post-body", "post-content", "story", "story-text", "text"]
NAV_NAMES = ["breadcrumb", "main-nav", "menu", "nav", "navbar", "navigation", "pagination", "site-nav", "topbar"]
HEADER_NAMES = ["banner", "header", "masthead", "page-header", "site-header"]
FOOTER_NAMES = ["bottom", "colophon", "copyright", "footer", "legal", "site-footer"]
SIDE_NAMES = ["aside", "popular", "recommended", "related", "sidebar", "social", "share", "tags", "widget"]
AD_NAMES = ["ad", "ads", "advert", "advertisement", "promo", "sponsor", "sponsored"]
NOTICE_NAMES = ["alert", "consent", "cookie", "cookie-notice", "gdpr", "modal", "newsletter", "notice", "overlay", "popup", "subscribe"]
COMMENT_NAMES = ["comment", "comment-list", "comments", "discussion", "disqus", "replies", "respond"]


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        syllables = ["ba", "con", "de", "en", "fir", "go", "ha", "in", "ku", "lo", "men", "no", "or", "pa", "qui", "re", "st", "ti", "un", "ver"]
        out = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        text = " ".join(w + (r.choice(",.;") if r.random() < 0.12 else "") for w in out)
        return text.capitalize() + r.choice([".", ".", "!", ""])

    def links(self, n: int, sep: str = " ") -> str:
        return sep.join(f'<a href="/{k}">{self.words(1, 3)}</a>' for k in range(n))

    def items(self, n: int) -> str:
        return "<ul>" + "".join(f"<li>{self.links(1)}</li>" for _ in range(n)) + "</ul>"

    def open(self, tags: list[str], names: list[str], bare: float = 0.2) -> tuple[str, str]:
        tag = self.r.choice(tags)
        key = self.r.choice(["class", "class", "id"])
        return (f"<{tag}>" if self.r.random() < bare and tag != "div" else f'<{tag} {key}="{self.r.choice(names)}">'), f"</{tag}>"

    def box(self, tags: list[str], names: list[str], inner: str, bare: float = 0.2) -> str:
        a, b = self.open(tags, names, bare)
        return a + inner + b

    def paragraphs(self) -> str:
        r, out = self.r, []
        for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
            kind = r.random()
            text = self.words(2, r.choice([5, 15, 40, 90]))
            if r.random() < 0.2:
                text += f" {self.links(1)} " + self.words(2, 9)
            if kind < 0.7:
                out.append(f"<p>{text}</p>" if r.random() < 0.85 else f"<p><b>{text}<br>")
            elif kind < 0.8:
                out.append(f"<h2>{self.words(1, 7)}</h2>")
            elif kind < 0.87:
                out.append("<ul>" + "".join(f"<li>{self.words(2, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.96:
                out.append(f"<figure><figcaption>{self.words(3, 12)}</figcaption></figure>")
            else:
                out.append(f"<div>{text}</div>")
        return "".join(out)

    def comments(self) -> str:
        r = self.r
        one = lambda: f'<div class="{r.choice(COMMENT_NAMES)}"><b>{self.words(1, 2)}</b><p>{self.words(4, 40)}</p></div>'
        return self.box(["div", "section", "ol"], COMMENT_NAMES, f"<h3>{self.words(1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 5))), 0)

    def inside(self) -> str:
        """What stands within an article without being part of it."""
        parts: list[Callable[[], str]] = [
            lambda: self.box(["div", "aside"], AD_NAMES, self.words(3, 20), 0), lambda: self.box(["div", "aside"], SIDE_NAMES, self.items(4), 0.2),
            lambda: self.box(["div"], NOTICE_NAMES, self.words(5, 25), 0), lambda: f"<form><label>{self.words(1, 3)}</label><input><button>{self.words(1, 2)}</button></form>",
            lambda: f"<script>var a=\"{self.words(2, 5)}\";</script>", self.comments]
        return self.r.choice(parts)()

    def article(self) -> str:
        r = self.r
        title = f"<h1>{self.words(2, 10)}</h1>"
        body = title * (r.random() < 0.8) + self.paragraphs()
        for _ in range(r.choice([0, 0, 1, 2])):
            body += self.inside() + (self.paragraphs() if r.random() < 0.5 else "")
        tag, close = self.open(["article", "article", "main", "div", "section", "div"], ARTICLE_NAMES, 0.5)
        out = f"{tag[:-1]} {KNOWN}>" + body + close
        for _ in range(r.choice([0, 0, 1, 2])):
            out = self.box(["div", "main", "section"], ["container", "wrapper", "page", "row", "main", "content"], self.inside() * (r.random() < 0.3) + out + self.inside() * (r.random() < 0.3), 0.3)
        return out

    def page(self) -> str:
        r = self.r
        head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        before: list[Callable[[], str]] = [
            lambda: self.box(["header", "div"], HEADER_NAMES, f"<h1>{self.words(1, 3)}</h1>" * (r.random() < 0.4) + self.words(2, 10) + self.links(r.randint(0, 4)), 0.5),
            lambda: self.box(["nav", "div"], NAV_NAMES, self.items(r.randint(3, 9)), 0.6), lambda: self.box(["div", "section"], NOTICE_NAMES, f"<p>{self.words(5, 40)}</p><button>OK</button>", 0),
            lambda: self.box(["div"], AD_NAMES, self.words(3, 20), 0), lambda: f"<!-- {self.words(1, 3)} -->"]
        after: list[Callable[[], str]] = [
            self.comments, lambda: self.box(["aside", "div"], SIDE_NAMES, f"<h3>{self.words(1, 3)}</h3>" + (self.items(5) if r.random() < 0.6 else f"<p>{self.words(5, 40)}</p>"), 0.5),
            lambda: self.box(["footer", "div"], FOOTER_NAMES, "&copy; " + self.words(3, 25) + self.links(r.randint(0, 4)), 0.5), lambda: self.box(["div"], AD_NAMES, self.words(3, 20), 0),
            lambda: f"<form action=\"/s\"><label>{self.words(1, 4)}</label><input><button>{self.words(1, 2)}</button></form>"]
        return head + "".join(p() for p in r.sample(before, r.randint(1, 4))) + self.article() + "".join(p() for p in r.sample(after, r.randint(1, 4))) + "</body></html>"

"""Labelled web pages for the extraction model.

Every page is written from a rule: a layout, names for its parts, and words from a seeded
generator.  The attribute ``data-y`` labels a node and, unless it is set again, those
below it: 1 for the article, 0 for what surrounds it.
"""

from __future__ import annotations

import random

#: Names that sites give to the parts of their pages.
CONTENT = ["content", "article", "post", "entry", "entry-content", "post-body", "story", "main-content", "article-body", "text", "page-content", "blog-post", "inhalt", "beitrag", "contenido", "articulo", "contenu", "texte", "konten", "artikel"]
MENU = ["nav", "menu", "navbar", "navigation", "main-menu", "topnav", "breadcrumbs", "breadcrumb", "pagination", "tabs", "navigacion", "menue", "navigasi"]
HEAD = ["header", "masthead", "top", "site-header", "branding", "logo", "kopf", "cabecera", "entete"]
FOOT = ["footer", "site-footer", "copyright", "legal", "bottom", "foot", "fuss", "pie", "pied", "impressum"]
SIDE = ["sidebar", "side", "aside", "widget", "related", "recommended", "most-read", "tags", "rail", "toc", "seitenleiste", "lateral", "terkait"]
ADS = ["ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner", "sponsored", "ad-slot", "werbung", "anzeige", "publicidad", "publicite", "iklan"]
NOTICES = ["cookie", "cookie-notice", "consent", "notice", "gdpr", "popup", "modal", "alert", "newsletter", "subscribe", "disclaimer", "hinweis", "aviso", "avis"]
COMMENTS = ["comments", "comment", "comment-list", "replies", "reply", "discussion", "responses", "disqus", "kommentare", "comentarios", "commentaires", "komentar"]
SHARE = ["share", "social", "share-bar", "social-links", "follow", "teilen", "compartir", "partager", "bagikan"]
FORMS = ["form", "search", "login", "search-form", "signup", "contact-form"]


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        letters = ["an", "en", "or", "ti", "sh", "ou", "le", "qu", "st", "er", "ä", "é", "ó", "b", "d", "m"]
        out = ["".join(self.r.choice(letters) for _ in range(self.r.randint(1, 4))) for _ in range(self.r.randint(low, high))]
        return (" ".join(out)).capitalize() + self.r.choice([".", ".", "", "!", ", " + out[0] + "."])

    def paragraph(self) -> str:
        text = " ".join(self.words(3, 18) for _ in range(self.r.choice([1, 1, 2, 3, 6, 10])))
        text = self.r.choice([text, text, text, f"<b>{text}<br>", f"<em>{self.words(1, 3)}</em> {text}", f'{text} <a href="/x">{self.words(1, 3)}</a> {self.words(2, 8)}'])
        return f"<p>{text}" + self.r.choice(["</p>", "</p>", "</p>", ""])

    def name(self, names: list[str]) -> str:
        kind = self.r.choice(["class", "class", "id"])
        return f'{kind}="{self.r.choice(names)}"' if self.r.random() < 0.9 else ""

    def links(self, tag: str = "ul") -> str:
        return f"<{tag}>" + "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(self.r.randint(2, 8))) + f"</{tag}>"

    def article(self) -> str:
        parts = [f"<h1>{self.words(2, 9)}</h1>"] if self.r.random() < 0.8 else []
        curt = self.r.random() < 0.15  # some articles are lists of words, a few to a paragraph
        for _ in range(self.r.choice([0, 1, 1, 2, 2, 4, 4, 7, 7, 30, 120])):
            parts.append(f"<p>{self.words(1, 4)}</p>" if curt else self.paragraph())
            x = self.r.random()
            if x < 0.08:
                parts.append(f"<h2>{self.words(2, 6)}</h2>")
            elif x < 0.13:
                parts.append("<ul>" + "".join(f"<li>{self.words(3, 12)}</li>" for _ in range(3)) + "</ul>")
            elif x < 0.17:
                parts.append(f"<blockquote><p>{self.words(5, 20)}</p></blockquote>")
            elif x < 0.20:
                parts.append(f"<table><tr><td>{self.words(1, 5)}</td><td>{self.words(1, 5)}</td></tr></table>")
            elif x < 0.23:
                parts.append(f"<figure><figcaption>{self.words(3, 9)}</figcaption></figure>")
            elif x < 0.28:
                parts.append(self.junk(inside=True))
        if len(parts) > 2 and self.r.random() < 0.25:  # parts of an article have wrappers of their own
            half = len(parts) // 2
            tag = self.r.choice(["div", "section", "div class=\"row\"", "section class=\"chapter\""])
            parts = [f"<{tag}>", *parts[:half], f"</{tag.split()[0]}>", f"<{tag}>", *parts[half:], f"</{tag.split()[0]}>"]
        return "".join(parts) or self.paragraph()

    def junk(self, inside: bool = False) -> str:
        """A block that is no part of the article."""
        kinds = [ADS, ADS, NOTICES, SHARE, SIDE, FORMS] + ([COMMENTS] if inside else [MENU, HEAD, FOOT])
        names = self.r.choice(kinds)
        tag = self.r.choice(["div", "div", "section", "aside"] if names is not FORMS else ["form", "div"])
        body = self.r.choice([self.words(2, 12), self.links(), f"<p>{self.words(4, 20)}</p>", f"<span>{self.words(1, 6)}</span><p>{self.words(4, 14)}</p>"])
        name = f'class="{self.r.choice(names)}"' if tag in ("div", "section") else self.name(names)
        return f'<{tag} {name} data-y="0">{body}</{tag}>'

    def comments(self) -> str:
        one = lambda: f'<{self.r.choice(["div", "li", "article"])} class="comment">{self.paragraph()}'
        return f'<{self.r.choice(["section", "div"])} {self.r.choice(["class", "id"])}="{self.r.choice(COMMENTS)}" data-y="0"><h3>{self.words(1, 3)}</h3>' + "".join(one() for _ in range(self.r.randint(1, 4))) + "</section></div>"

    def page(self) -> str:
        r = self.r
        head = '<!DOCTYPE html><html><head><meta charset="utf-8"><title>t</title><style>p{}</style><script>var t="</p>";</script></head>'
        nav = r.choice([f'<nav data-y="0">{self.links()}</nav>', f'<div {self.name(MENU)} data-y="0">{self.links()}</div>', f'<header data-y="0"><h2>{self.words(1, 3)}</h2><nav>{self.links()}</nav></header>', f'<div {self.name(HEAD)} data-y="0"><h1>{self.words(1, 3)}</h1>{self.links()}</div>', f'<header data-y="0"><{(h := r.choice(["h1", "h2", "p"]))}>{self.words(1, 4)}</{h}></header>', ""])
        foot = r.choice([f'<footer data-y="0">&copy; {self.words(1, 3)} &middot; {self.words(2, 14)}</footer>', f'<div class="{r.choice(FOOT)}" data-y="0"><p>{self.words(2, 12)}</p></div>', f'<footer data-y="0">{self.links()}<p>{self.words(2, 12)}</p></footer>', ""])
        side = r.choice(["", "", f'<aside data-y="0"><h3>{self.words(1, 3)}</h3>{self.links()}</aside>', f'<div class="{r.choice(SIDE)}" data-y="0"><p>{self.words(3, 14)}</p>{self.links()}</div>'])
        body = self.article()
        core = r.choice(
            [
                f"<article>{body}</article>",
                f"<article>{body}</article>",
                f"<main><article>{body}</article></main>",
                f"<div class=\"{r.choice(CONTENT)}\">{body}</div>",
                f"<div id=\"{r.choice(CONTENT)}\"><div class=\"{r.choice(CONTENT)}\">{body}</div></div>",
                f"<main>{body}</main>",
                f"<table><tr><td class=\"{r.choice(MENU)}\" data-y=\"0\">{self.links()}</td><td class=\"{r.choice(CONTENT)}\">{body}</td></tr></table>",
                f"<div>{body}</div>",
                f"<div><div>{body}</div></div>",
                f"<section class=\"{r.choice(CONTENT)}\">{body}</section>",
                f"<section>{body}</section>",
                "<div>" * (deep := r.randint(1, 4)) + body + "</div>" * deep,
                "<div>" * (deep := r.randint(1, 4)) + self.paragraph() + "</div>" * deep,
                "<section>" * (deep := r.randint(1, 3)) + self.paragraph() + "</section>" * deep,
                "<div><div>" + "</div><div>".join(self.paragraph() for _ in range(r.randint(1, 3))) + "</div></div>",
                f"<div class=\"wrapper\"><div class=\"{r.choice(CONTENT)}\"><article>{body}</article></div></div>",
                body,
            ]
        )
        around = [self.junk() if r.random() < 0.5 else "" for _ in range(2)]
        if r.random() < 0.12:  # a fragment without its page
            return r.choice([core, core + foot, nav + core, self.words(3, 60), f"<p>{self.words(3, 30)}</p>", body + self.comments()])
        parts = [nav, around[0], side if r.random() < 0.3 else "", core, self.comments() if r.random() < 0.35 else "", side, around[1], foot]
        return f'{head}<body data-y="1">' + "".join(parts) + r.choice(["</body></html>", "</body></html>", ""])


def labelled_pages(count: int = 400, seed: int = 7) -> list[str]:
    return [Writer(seed * 100_003 + i).page() for i in range(count)]

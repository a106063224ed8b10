"""Labelled sample pages: templates with marked regions, from a seed. They train the extraction model."""

from __future__ import annotations

import random

#: Class names that carry no hint, as minified style sheets have them.
BLANK = ("x1", "c-42", "jss9", "css-1q2w", "wrap", "row", "inner", "box", "grid", "layer", "")
SYLLABLES = "an be co de er fi ga ho in ka la me no or pe ra se ti un ve".split()

PARTS = {
    "nav": [("nav", ""), ("div", "nav"), ("ul", "menu"), ("div", "main-menu"), ("div", "breadcrumb"), ("nav", "x1"), ("div", "navbar"), ("div", "pagination")],
    "header": [("header", ""), ("div", "header"), ("div", "masthead"), ("header", "site-header"), ("div", "topbar")],
    "footer": [("footer", ""), ("div", "footer"), ("footer", "site-footer"), ("div", "copyright"), ("div", "legal")],
    "side": [("aside", ""), ("div", "sidebar"), ("div", "widget"), ("aside", "rail"), ("div", "side-column"), ("section", "sidebar-right")],
    "ad": [("div", "ad"), ("div", "advert"), ("div", "ads"), ("div", "sponsored"), ("div", "promo"), ("aside", "ad-slot"), ("p", "ad"), ("section", "banner-ad"), ("div", "advertisement")],
    "notice": [("div", "cookie-notice"), ("div", "notice"), ("div", "alert"), ("div", "consent"), ("div", "newsletter"), ("div", "popup"), ("p", "notice"), ("section", "gdpr"), ("div", "subscribe-box"), ("dialog", "")],
    "comment": [("div", "comments"), ("section", "comments"), ("div", "comment-list"), ("ol", "commentlist"), ("div", "replies"), ("section", "discussion"), ("div", "reader-comments"), ("div", "disqus")],
    "social": [("div", "share"), ("div", "social-links"), ("div", "related"), ("section", "related-posts"), ("div", "tags"), ("ul", "sharing")],
    "form": [("form", ""), ("form", "search-form"), ("form", "login"), ("div", "contact-form"), ("form", "newsletter-form")],
}
CONTENT = [("article", ""), ("article", "post"), ("div", "content"), ("main", ""), ("div", "article-body"), ("div", "entry-content"), ("section", "story"), ("div", "post"), ("div", "main-content"), ("article", "x1"), ("div", "text")]


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.out, self.marks = rng, [], []

    def words(self, lo: int, hi: int) -> str:
        r = self.rng
        words = ["".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        for k in range(r.randint(4, 14), len(words), 9):
            words[k - 1] += r.choice((".", ",", ".", "?"))
        return " ".join(words).capitalize()

    def sentence(self, lo: int, hi: int) -> str:
        return self.words(lo, hi) + "."

    def open(self, tag: str, name: str, mark: str = ""):
        key = self.rng.choice(("class", "class", "class", "id"))
        self.out.append(f"<{tag}" + (f' {key}="{name}"' if name else "") + (f' data-mark="{mark}"' if mark else "") + ">")

    def add(self, text: str):
        self.out.append(text)

    def boiler(self, kind: str):
        r = self.rng
        tag, name = r.choice(PARTS[kind])
        self.open(tag, name, "boiler")
        if kind in ("nav", "social") or kind in ("header", "footer", "side") and r.random() < 0.5:
            if kind == "header":
                self.add(f"<h1>{self.words(1, 4)}</h1>" if r.random() < 0.4 else f"<div>{self.words(1, 4)}</div>")
            item = lambda: f'<a href="/{self.words(1, 1)}">{self.words(1, 4)}</a>'
            if tag in ("ul", "ol"):
                self.add("".join(f"<li>{item()}</li>" for _ in range(r.randint(3, 8))))
            else:
                inner = r.choice(("ul", "span", "div"))
                self.add("<ul>" + "".join(f"<li>{item()}" + "</li>" * r.randint(0, 1) for _ in range(r.randint(2, 8))) + "</ul>" if inner == "ul" else "".join(f"<{inner}>{item()}</{inner}>" for _ in range(r.randint(2, 7))))
        elif kind == "comment":
            for _ in range(r.randint(1, 5)):
                box = "li" if tag == "ol" else r.choice(("div", "article", "div", "p"))
                body = self.sentence(5, 60)
                self.add(f"<{box}>" + (f"<p>{body}</p>" if box != "p" and r.random() < 0.7 else body) + f"</{box}>")
            if r.random() < 0.3:
                self.add(f"<form><label>{self.words(1, 3)}</label><textarea>{self.words(1, 3)}</textarea><button>{self.words(1, 2)}</button></form>")
        elif kind == "form":
            self.add(f"<label>{self.words(1, 3)}</label><input name=q><select><option>{self.words(1, 1)}<option>{self.words(1, 1)}</select><button>{self.words(1, 2)}</button>" + (f"<p>{self.sentence(4, 15)}</p>" if r.random() < 0.4 else ""))
        else:
            for _ in range(r.randint(1, 3)):
                body = self.sentence(3, 40 if kind in ("ad", "notice", "side", "footer") else 15)
                shape = r.random()
                if tag == "p" or shape < 0.4:
                    self.add(body)
                    break
                self.add(f"<p>{body}</p>" if shape < 0.8 else f"<div><h3>{self.words(1, 5)}</h3><p>{body}</p></div>")
        self.add(f"</{tag}>")

    def paragraph(self):
        r = self.rng
        kind = r.random()
        if kind < 0.68:
            body = self.sentence(1, 90) if r.random() < 0.85 else self.words(1, 8)
            if r.random() < 0.2:
                body = f"<b>{body}" + ("</b>" if r.random() < 0.6 else "<br>")
            if r.random() < 0.25:
                body += f' <a href="/x">{self.words(1, 4)}</a> ' + self.sentence(1, 20)
            self.add(f"<p>{body}" + ("</p>" if r.random() < 0.9 else ""))
        elif kind < 0.76:
            self.add(f"<{(h := r.choice(('h2', 'h3', 'h4')))}>{self.words(1, 8)}</{h}>")
        elif kind < 0.84:
            self.add("<ul>" + "".join(f"<li>{self.sentence(2, 25)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.89:
            self.add(f"<blockquote><p>{self.sentence(5, 40)}</p></blockquote>")
        elif kind < 0.93:
            self.add("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 6)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
        elif kind < 0.96:
            self.add(f"<figure><img src=a.png><figcaption>{self.sentence(3, 15)}</figcaption></figure>")
        else:
            self.add(f"<div>{self.sentence(4, 50)}</div>")

    def article(self):
        r = self.rng
        tag, name = r.choice(CONTENT) if r.random() < 0.85 else ("div", r.choice(BLANK))
        if r.random() < 0.35:
            tag, name = "article", ""
        self.open(tag, name, "content")
        inner = r.random() < 0.2
        if r.random() < 0.85:
            self.add(f"<h1>{self.words(2, 12)}</h1>")
        if inner:
            self.open("div", r.choice(("entry", "body", "text", *BLANK)))
        for _ in range(r.randint(1, 9)):
            self.paragraph()
            if r.random() < 0.06:
                self.boiler(r.choice(("ad", "social", "form", "notice", "nav", "side")))
        if inner:
            self.add("</div>")
        if r.random() < 0.12:
            self.boiler(r.choice(("comment", "social", "comment")))
        self.add(f"</{tag}>")


def sample_pages(n: int = 400, seed: int = 11) -> list[str]:
    """Pages in which ``data-mark`` tells the roots of content and of boilerplate."""
    rng, pages = random.Random(seed), []
    for k in range(n):
        page = _Page(rng)
        kind = k % 25
        if kind == 0:  # fragments without a frame
            page.add('<div data-mark="content">')
            for _ in range(rng.randint(1, 6)):
                page.paragraph()
            page.add("</div>")
        elif kind == 1:  # nothing but boilerplate
            for part in rng.sample(sorted(PARTS), 3):
                page.boiler(part)
        else:
            page.add("<!DOCTYPE html><html><head><title>" + page.words(2, 8) + "</title></head><body>")
            wrapped = [rng.choice(BLANK) for _ in range(rng.choice((0, 0, 1, 2)))]
            before = [p for p in ("notice", "header", "nav", "ad", "form", "side") if rng.random() < 0.4]
            for part in before[: len(before) // 2]:
                page.boiler(part)
            for name in wrapped:
                page.open("div", name)
            for part in before[len(before) // 2 :]:
                page.boiler(part)
            page.article()
            after = [p for p in ("social", "comment", "ad", "side", "form") if rng.random() < 0.35]
            for part in after:
                page.boiler(part)
            page.add("</div>" * len(wrapped))
            for part in ("notice", "nav", "footer"):
                if rng.random() < 0.45:
                    page.boiler(part)
            page.add("</body></html>")
        pages.append("".join(page.out))
    return pages

"""Labelled pages to train the extraction on: layouts drawn at random, filled with invented words.

A page is made of an article and of the parts that surround or interrupt it.  Every part is written in
one of several ways (by its own element, by a ``div`` with a telling class, or bare), the words are
syllables drawn anew for each page, so that only tags, classes, links, punctuation and order can be
learned, not a language.  Texts of the article begin with :data:`MARK`.
"""

from __future__ import annotations

import random

MARK = ""

#: What page parts are commonly called in class and id attributes.
CALLED = {
    "menu": "nav navbar navigation menu main-menu topnav site-nav breadcrumb breadcrumbs links tabs toc pagination pager",
    "header": "header site-header masthead top topbar banner-top branding logo page-header hero-bar",
    "footer": "footer site-footer bottom colophon page-footer copyright legal imprint credits",
    "sidebar": "sidebar side aside widget widget-area rail right-column left-column secondary related recommended popular trending more-stories teaser",
    "notice": "notice cookie cookie-banner consent gdpr alert message warning disclaimer popup modal overlay paywall banner announcement",
    "advert": "ad ads advert advertisement adbox ad-slot sponsor sponsored promo promotion banner-ad dfp commercial partner",
    "form": "form search searchbox login signup newsletter subscribe subscription contact poll survey",
    "comments": "comments comment comment-list comment-body discussion replies reply responses disqus thread user-comments respond feedback",
    "share": "share social sharing tags meta byline-links follow tools toolbar buttons",
}
ARTICLE = "article content main post entry entry-content story article-body post-body text body-text maincontent page-content prose markdown".split()
#: Words that such parts often hold.
SAYS = {
    "menu": "Home News About Contact Sports World Next Previous Login Archive Start Accueil Inicio Kontakt",
    "header": "Welcome Daily Magazine Blog Search Login Subscribe Today",
    "footer": "© &copy; Copyright Privacy Terms Imprint rights reserved Contact Impressum Datenschutz 2024 &middot;",
    "sidebar": "Related Popular Recent Most read More stories Archive Categories Tags",
    "notice": "We use cookies Accept Please enable JavaScript Your browser This site By continuing you agree Subscribe to read",
    "advert": "Advertisement Sponsored Buy now Sale Offer Anzeige Publicité Shop",
    "form": "Name Email Submit Search Password Send Sign up Newsletter Your message Log in",
    "comments": "Reply says commented Posted Anonymous ago Like Report Comments Leave a comment",
    "share": "Share Tweet Facebook Print Email Follow us Tags",
}
COMMON = [w.lower() for k in sorted(SAYS) for w in SAYS[k].split() if w.isalpha()]
OWN_TAG = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}


class _Page:
    def __init__(self, rnd: random.Random):
        self.rnd = rnd
        letters = rnd.choice(["aeiou bcdfghlmnprst", "aeiouäöü bcdfghklmnprstw", "aeiouéèê bcdlmnprstv", "аеиоу бвгдклмнпрст", "aeiouáíó bcdlmnñprst"])
        vowels, rest = letters.split(" ")
        self.syllables = [rnd.choice(rest) + rnd.choice(vowels) + rnd.choice(["", "", rnd.choice(rest)]) for _ in range(40)]
        self.semantic = rnd.random() < 0.55  # parts by their own element
        self.classes = rnd.random() < 0.8
        self.junk = rnd.random() < 0.15
        self.common = rnd.choice((0.0, 0.05, 0.15, 0.4))  # share of words of any text that page parts hold too

    def word(self) -> str:
        rnd = self.rnd
        if rnd.random() < self.common:
            return rnd.choice(COMMON)
        w = "".join(rnd.choice(self.syllables) for _ in range(rnd.choice((1, 1, 2, 2, 3, 4))))
        if self.junk and rnd.random() < 0.7:
            w += rnd.choice(("###", "%%%", "&amp;&amp;", "***", "$$$"))
        if rnd.random() < 0.01:
            w = rnd.choice(("12", "3.5%", "2021", "a@b.example", "+1 (555) 555-0000", "4111111111111111", "http://x.example/"))
        return w

    def sentence(self, n: int) -> str:
        words = [self.word() for _ in range(max(n, 1))]
        words[0] = words[0].capitalize()
        for i in range(3, len(words) - 1):
            if self.rnd.random() < 0.08:
                words[i] += ","
        if self.rnd.random() < 0.03:
            i = self.rnd.randrange(len(words))
            words[i] = f'<a href="/x">{words[i]}</a>'
        return " ".join(words) + self.rnd.choice((".", ".", ".", ".", "?", "!", ":"))

    def prose(self, most: int = 120) -> str:
        n, out = int(most ** self.rnd.random()), []
        while n > 0:
            k = self.rnd.randint(1, 18)
            out.append(self.sentence(min(k, n)))
            n -= k
        return " ".join(out)

    def said(self, kind: str) -> str:
        words = SAYS[kind].split()
        i = self.rnd.randrange(len(words))
        return " ".join(words[i : i + self.rnd.randint(1, 4)])

    def short(self, kind: str) -> str:
        return self.said(kind) if self.rnd.random() < 0.35 else " ".join(self.word() for _ in range(self.rnd.randint(1, 5)))

    def attr(self, names: list[str], chance: float = 1.0) -> str:
        if self.rnd.random() >= chance:
            return ""
        value = " ".join(self.rnd.sample(names, self.rnd.choice((1, 1, 1, 2))))
        value = self.rnd.choice(("", "", "", "x-", "c1-")) + value + self.rnd.choice(("", "", "", "-1", "_box", "-wrapper", " clearfix"))
        return f' {self.rnd.choice(("class", "class", "class", "id"))}="{value}"'

    def wrap(self, kind: str, inner: str, own: bool | None = None) -> str:
        own = self.semantic if own is None else own
        tag = OWN_TAG.get(kind, "div") if own else "div"
        named = self.attr(CALLED[kind].split(), 0.3 if tag != "div" else 1.0 if self.classes or kind in ("advert", "notice", "comments", "share") else 0.5)
        if kind == "comments":
            tag = self.rnd.choice(("section", "div", "ol", "ul", "aside"))
            named = self.attr(CALLED[kind].split())
        return f"<{tag}{named}>{inner}</{tag}>"

    def part(self, kind: str) -> str:
        rnd = self.rnd
        if kind in ("menu", "share", "sidebar") and rnd.random() < 0.75:
            items = [f'<a href="/{i}">{self.short(kind)}</a>' for i in range(rnd.randint(2, 9))]
            inner = rnd.choice((lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<p>{x}</p>" for x in items), lambda: "".join(f"<span>{x}</span> " for x in items)))()
            if kind == "sidebar" and rnd.random() < 0.7:
                inner = f"<h3>{self.short(kind)}</h3>" + inner + (f"<p>{self.prose(40)}</p>" if rnd.random() < 0.4 else "")
        elif kind == "form":
            inner = f"<label>{self.said(kind)}</label> <input type=text> <button>{self.said(kind)}</button>" + (f"<p>{self.prose(25)}</p>" if rnd.random() < 0.5 else "") + (f"<select><option>{self.word()}<option>{self.word()}</select>" if rnd.random() < 0.2 else "")
        elif kind == "comments":
            each = []
            for _ in range(rnd.randint(1, 6)):
                who = rnd.choice((f"<b>{self.word()}</b> {self.said(kind)}", f'<span class="author">{self.word()}</span>', f"<h4>{self.word()}</h4>", ""))
                tag = rnd.choice(("li", "div", "p", "article"))
                named = self.attr(["comment", "comment-body", "reply", "post"], 0.6)
                each.append(f"<{tag}{named}>{who}<p>{self.prose(80)}</p></{tag}>" if tag != "p" else f"<p{named}>{who} {self.prose(80)}</p>")
            inner = (f"<h3>{self.said(kind)}</h3>" if rnd.random() < 0.6 else "") + "".join(each)
        elif kind == "header":
            inner = rnd.choice((f"<h1>{self.short(kind)}</h1>", f"<a href='/'>{self.short(kind)}</a>", f"<p>{self.prose(12)}</p>", self.short(kind))) + (self.part("menu") if rnd.random() < 0.4 else "")
        else:
            text = self.prose(40) if rnd.random() < 0.6 else self.short(kind)
            if rnd.random() < 0.4:
                text = self.said(kind) + " " + text
            inner = rnd.choice((text, f"<p>{text}</p>", f"<p>{text}<p>{self.prose(30)}", f"<a href='/ad'>{text}</a>", f"<span>{text}</span>"))
        return self.wrap(kind, inner)

    def body(self) -> str:
        rnd = self.rnd
        out = []
        if rnd.random() < 0.75:
            title = f"<h1>{MARK}{self.sentence(rnd.randint(1, 12))}</h1>"
            out.append(f"<header>{title}</header>" if rnd.random() < 0.12 else title)
        breaks = rnd.random() < 0.3
        lasting = rnd.random() < 0.5  # paragraphs by an element each
        for _ in range(int(30 ** rnd.random())):
            kind = rnd.random()
            text = MARK + self.prose(rnd.choice((6, 60, 150)))
            if breaks and kind < 0.3:
                out.append(f"<p><b>{text}<br>")
            elif kind < 0.78:
                out.append(f"<p>{text}</p>" if lasting or rnd.random() < 0.8 else f"<p>{text}" if rnd.random() < 0.5 else f"<div>{text}</div>")
            elif kind < 0.84:
                out.append(f"<h{rnd.choice((2, 2, 3))}>{MARK}{self.sentence(rnd.randint(1, 7))}</h2>")
            elif kind < 0.88:
                tag = rnd.choice(("ul", "ol"))
                out.append(f"<{tag}>" + "".join(f"<li>{MARK}{self.sentence(rnd.randint(1, 15))}</li>" for _ in range(rnd.randint(2, 6))) + f"</{tag}>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.92:
                out.append(f"<figure><img src=x><figcaption>{MARK}{self.sentence(6)}</figcaption></figure>")
            elif kind < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{MARK}{self.word()}<td>{MARK}{self.sentence(3)}" for _ in range(rnd.randint(1, 4))) + "</table>")
            elif kind < 0.95:
                out.append(f"<pre>{MARK}{self.sentence(8)}</pre>")
            else:
                out.append(self.part(rnd.choice(("advert", "advert", "share", "form", "notice", "sidebar"))))
        if rnd.random() < 0.2:
            out.append(self.part(rnd.choice(("share", "comments", "sidebar"))))
        return "".join(out)

    def article(self) -> str:
        rnd = self.rnd
        inner = self.body()
        if self.semantic or rnd.random() < 0.3:
            inner = f"<article{self.attr(ARTICLE, 0.3)}>{inner}</article>"
            return f"<main{self.attr(ARTICLE, 0.2)}>{inner}</main>" if rnd.random() < 0.3 else inner
        if self.classes:
            inner = f"<div{self.attr(ARTICLE)}>{inner}</div>"
            return f"<{rnd.choice(('div', 'section', 'main'))}{self.attr([*ARTICLE, 'container', 'wrap', 'row', 'col'], 0.7)}>{inner}</div>" if rnd.random() < 0.4 else inner
        return rnd.choice((inner, f"<div>{inner}</div>", f"<table><tr><td>{inner}</td></tr></table>"))

    def html(self) -> str:
        rnd = self.rnd
        before = [k for k, p in (("notice", 0.2), ("header", 0.4), ("menu", 0.75), ("form", 0.15), ("advert", 0.4), ("sidebar", 0.15)) if rnd.random() < p]
        after = [k for k, p in (("share", 0.2), ("advert", 0.2), ("comments", 0.3), ("sidebar", 0.35), ("form", 0.2), ("menu", 0.1), ("footer", 0.75), ("notice", 0.15)) if rnd.random() < p]
        if rnd.random() < 0.3:
            rnd.shuffle(before)
        fragment = rnd.random() < 0.1
        if fragment and rnd.random() < 0.4:
            return rnd.choice(("<p>{}</p>", "<div>{}</div>", "{}", "<p>{}", "<article>{}</article>", "<html><body>{}</body></html>", "<html><body><p>{}")).format(MARK + self.prose(100))
        if rnd.random() < (0.6 if fragment else 0.06):
            before, after = [], []
        middle = "".join(self.part(k) for k in before) + self.article() + "".join(self.part(k) for k in after)
        if rnd.random() < 0.25:
            middle = f"<div{self.attr(['page', 'wrapper', 'container', 'site', 'root'])}>{middle}</div>"
        if fragment:
            return middle
        return f"<!DOCTYPE html><html><head><title>{self.sentence(6)}</title><script>var x='<p>';</script></head><body>{middle}" + rnd.choice(("</body></html>", "</body></html>", ""))


def labelled_pages(n: int, seed: int) -> list[str]:
    """``n`` pages; the texts of their articles begin with :data:`MARK`."""
    return [_Page(random.Random(f"{seed}-{i}")).html() for i in range(n)]

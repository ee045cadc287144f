"""Labelled pages to learn extraction from: page layouts by rule, filled with invented words.

A page is markup whose main text is marked by the attribute ``data-main`` ("1" on, "0" off again,
inherited by inner elements). Anyone can label pages of their own in this way. The layouts vary in
elements, class words, order, markup errors and lengths, so that no single cue is always there.
"""

from __future__ import annotations

import random

PAGES, SEED = 1500, 11

#: Class and id words by the part of a page that they name.
MAIN = "content post entry article story body text main blog news page single".split()
PARTS = {
    "nav": "nav navbar menu navigation topnav breadcrumb breadcrumbs toc tabs pagination pager links".split(),
    "header": "header masthead banner topbar branding logo site hero top".split(),
    "footer": "footer colophon bottom copyright legal foot imprint disclaimer".split(),
    "side": "sidebar aside widget rail secondary related recommended popular trending more teaser promo".split(),
    "notice": "notice cookie cookies consent gdpr alert banner popup modal overlay message warning paywall privacy".split(),
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted".split(),
    "form": "form search newsletter subscribe signup login register contact subscription".split(),
    "comments": "comment comments reply replies respond discussion disqus reader feedback responses".split(),
    "share": "share social sharing tools meta tags author byline date".split(),
}
TAILS = "wrapper box inner container list item text body content section area block".split()
#: What short labels of such parts say, in the languages of the corpus.
SAYS = {
    "nav": "home menu about contact start kontakt inicio accueil news archive login blog impressum".split(),
    "side": ["related", "related posts", "most read", "popular", "mehr zum thema", "à lire aussi", "relacionado"],
    "comments": ["comments", "leave a reply", "kommentare", "commentaires", "comentarios", "reply", "antworten", "responder"],
    "notice": ["we use cookies", "accept", "accept cookies", "akzeptieren", "accepter", "aceptar", "ok"],
    "form": ["search", "subscribe", "sign up", "email", "name", "suche", "newsletter", "rechercher", "buscar", "send"],
    "ad": ["advertisement", "sponsored", "anzeige", "publicité", "publicidad", "ad"],
    "share": ["share", "tweet", "print", "teilen", "partager", "compartir"],
}
ELEMENTS = {"nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "side": ("aside", "div", "section"),
            "notice": ("div", "section", "dialog", "aside", "p"), "ad": ("div", "aside", "section", "p"), "form": ("form", "div"),
            "comments": ("section", "div", "ol"), "share": ("div", "ul", "p")}
SYLLABLES = "an be con de el for gra hen is jo ka lu mi no or per qui ra sen tu um ver wo xi yal zu ent ion ung eau".split()


class _Page:
    def __init__(self, rng: random.Random):
        self.rng = rng
        # some pages name nothing, some have no telling elements
        self.named = rng.random() < 0.8
        self.telling = rng.random() < 0.75
        self.careless = rng.random() < 0.3
        # the text of some pages is odd: lists with bars, signs, capitals, numbers, no full stops
        self.odd = rng.choice([None] * 6 + ["bars", "signs", "capitals", "numbers", "bare"])

    def word(self):
        return "".join(self.rng.choices(SYLLABLES, k=self.rng.randint(1, 4)))

    def words(self, low, high):
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def twisted(self, text):
        """A text of the article in the page's odd manner."""
        if self.odd == "bars":
            return text.replace(" ", " | ")
        if self.odd == "signs":
            return "".join(w + self.rng.choice(["### ", "*** ", "&amp;&amp; ", "%%% "]) for w in text.split(" "))
        if self.odd == "capitals":
            return text.upper()
        if self.odd == "numbers":
            return " ".join(self.rng.choice([w, str(self.rng.randint(1, 10 ** 6))]) for w in text.split(" "))
        return text.replace(".", "") if self.odd == "bare" else text

    def sentences(self, low, high):
        out = []
        for _ in range(self.rng.randint(low, high)):
            s = self.words(2, 18)
            out.append(s[0].upper() + s[1:] + self.rng.choice([".", ".", ".", "!", "?", ", " + self.word() + "."]))
        return " ".join(out)

    def link(self, text):
        return f'<a href="/{self.word()}">{text}</a>'

    def says(self, part):
        if part in SAYS and self.rng.random() < 0.5:
            return self.rng.choice(SAYS[part]).capitalize()
        return self.words(1, 3).capitalize()

    def name(self, part):
        """A class or id attribute for a part, or none."""
        if not self.named:
            return ""
        word = self.rng.choice(PARTS.get(part, MAIN))
        if self.rng.random() < 0.4:
            word += self.rng.choice("-_ ") + self.rng.choice(TAILS)
        return f' {self.rng.choice(["class", "class", "id"])}="{word}"'

    def wrap(self, part, inner, off=False):
        tags = ELEMENTS[part]
        # a part is told by its element or by its name; comments and adverts nearly always by a name
        tag = tags[0] if self.telling and self.rng.random() < 0.7 else self.rng.choice(tags)
        name = self.name(part)
        if not name and tag in ("div", "p", "section", "ul", "ol"):
            keep, self.named = self.named, True
            name, self.named = self.name(part), keep
        mark = ' data-main="0"' if off else ""
        return f"<{tag}{name}{mark}>{inner}</{tag}>"

    def menu(self, part="nav"):
        links = "".join(f"<li>{self.link(self.says(part))}</li>" for _ in range(self.rng.randint(2, 9)))
        return links if self.rng.random() < 0.2 else f"<ul>{links}</ul>"

    def part(self, part, off=False):
        r = self.rng
        if part == "nav":
            inner = self.menu()
        elif part == "header":
            inner = r.choice([f"<h1>{self.link(self.words(1, 3))}</h1>", f"<div>{self.words(1, 4)}</div>", f"<p>{self.sentences(1, 1)}</p>",
                              f"<h2>{self.words(1, 4)}</h2><p>{self.words(2, 6)}</p>"]) + (self.part("nav") if r.random() < 0.4 else "")
        elif part == "footer":
            inner = r.choice(["&copy; ", "© 2024 ", "Copyright ", ""]) + self.words(1, 4) + r.choice([" &middot; ", " | ", ". "]) + self.sentences(0, 2)
            inner = r.choice([inner, f"<p>{inner}</p>", f"<p>{inner}</p>{self.menu()}"])
        elif part == "side":
            inner = f"<h3>{self.says(part)}</h3>" + r.choice([self.menu(part), f"<p>{self.sentences(1, 3)}</p>",
                                                              "".join(f"<div>{self.link(self.sentences(1, 1))}</div>" for _ in range(r.randint(1, 4)))])
        elif part in ("notice", "ad"):
            inner = r.choice([self.sentences(1, 4), f"<p>{self.sentences(1, 3)}</p>", f"{self.says(part)} {self.sentences(0, 2)}",
                              f"<p>{self.says(part)}</p><p>{self.sentences(1, 2)}</p>"])
        elif part == "form":
            inner = r.choice(["", f"<h4>{self.says(part)}</h4>", f"<p>{self.sentences(1, 2)}</p>"]) + "".join(
                f"<label>{self.says(part)}</label> <input name=x>" for _ in range(r.randint(1, 3))) + "<button>Ok</button>"
        elif part == "comments":
            one = r.choice(["div", "li", "article", "p"])
            inner = f"<h3>{self.says(part)}</h3>" + "".join(
                f"<{one}{self.name(part)}>{r.choice([f'<b>{self.word()}</b>: ', f'<div>{self.words(1, 2)}</div>', ''])}"
                f"{r.choice(['{}', '<p>{}</p>', '<p>{}</p><p>{}</p>']).replace('{}', self.sentences(1, 5))}</{one}>" for _ in range(r.randint(1, 5)))
        else:
            inner = r.choice([self.menu(part), f"{self.says(part)} {self.words(1, 3)}", " | ".join(self.link(self.says(part)) for _ in range(3))])
        return self.wrap(part, inner, off)

    def article(self):
        r, out = self.rng, []
        if r.random() < 0.85:
            h = r.choice(["h1", "h1", "h2"])
            title = f"<{h}>{self.twisted(self.words(2, 9).capitalize())}</{h}>"
            out.append(r.choice([title, title, f"<header>{title}</header>", f"<div>{title}</div>"]))
        if r.random() < 0.15:
            out.append(self.part("share", off=True))
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.62:
                text = self.twisted(self.sentences(1, r.choice([1, 2, 6, 12])))
                if r.random() < 0.25:
                    text = text.replace(" ", f" {self.link(self.word())} ", 1)
                if r.random() < 0.2:
                    text = f"<b>{text}" + ("" if self.careless else "</b>")
                br = r.choice(["", "", "<br>"])
                out.append(f"<p>{text}{br}" + ("" if self.careless and r.random() < 0.4 else "</p>"))
            elif kind < 0.72:
                out.append(f"<p>{self.twisted(self.words(1, 5).capitalize() + '.')}</p>")
            elif kind < 0.8:
                out.append(f"<{r.choice(['h2', 'h3'])}>{self.words(1, 6).capitalize()}</h2>")
            elif kind < 0.85:
                items = "".join(f"<li>{self.words(2, 12)}" + r.choice(["", "."]) + ("" if self.careless else "</li>") for _ in range(r.randint(2, 6)))
                out.append(f"<ul>{items}</ul>")
            elif kind < 0.89:
                out.append(f"<blockquote>{r.choice(['{}', '<p>{}</p>']).replace('{}', self.sentences(1, 3))}</blockquote>")
            elif kind < 0.92:
                out.append(f"<div>{self.sentences(1, 5)}</div>")
            elif kind < 0.94:
                out.append(f"<figure><img src=x><figcaption>{self.words(3, 10)}</figcaption></figure>")
            elif kind < 0.96:
                cells = "".join(f"<tr><td>{self.words(1, 3)}</td><td>{r.randint(1, 999)}</td></tr>" for _ in range(r.randint(2, 5)))
                out.append(f"<table>{cells}</table>")
            else:
                out.append(self.part(r.choice(["ad", "ad", "side", "form", "share", "notice"]), off=True))
        return "".join(out)

    def container(self, inner):
        r = self.rng
        tag = r.choice(["article", "article", "main", "section"]) if self.telling else "div"
        name = self.name("main") if r.random() < (0.5 if self.telling else 1) else ""
        if tag == "div" and not name:
            name = f' class="{r.choice(MAIN)}"'
        body = f'<{tag}{name} data-main="1">{inner}</{tag}>'
        if r.random() < 0.25:
            body = f"<{r.choice(['main', 'div', 'section'])}{self.name('main')}>{body}{self.part('side') if r.random() < 0.4 else ''}</main>"
        return body

    def html(self):
        r = self.rng
        parts = [p for p, share in (("notice", 0.35), ("header", 0.5), ("nav", 0.75), ("ad", 0.4), ("form", 0.2)) if r.random() < share]
        if r.random() < 0.3:
            r.shuffle(parts)
        after = [p for p, share in (("share", 0.15), ("ad", 0.2), ("comments", 0.45), ("side", 0.45), ("form", 0.2), ("notice", 0.1), ("footer", 0.8))
                 if r.random() < share]
        inner = self.article()
        if "comments" in after and r.random() < 0.3:  # comments inside of the article
            after.remove("comments")
            inner += self.part("comments", off=True)
        out = "".join(map(self.part, parts)) + self.container(inner) + "".join(map(self.part, after))
        head = f"<head><title>{self.words(2, 5)}</title><style>p{{margin:0}}</style><script>x('</p>')</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{out}" + ("" if self.careless else "</body></html>")


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[str]:
    """``n`` labelled pages; equal arguments give equal pages."""
    rng = random.Random(seed)
    return [_Page(random.Random(rng.getrandbits(64))).html() for _ in range(n)]

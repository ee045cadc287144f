"""Leaf blocks of a web page: the pieces of text between the starts and ends of block elements.

One pass over the markup keeps the open block elements. A block knows the tags, class and id words
of all elements around it, its own element, the container it stands in, and its share of link text.
Markup errors follow the rules of browsers where they matter for text: a block start closes an open
paragraph, list items, cells and rows close their neighbours, end tags without a start are ignored
(but end a block), an unclosed comment or tag swallows the rest. The time is linear in the page.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

#: Fixed values of HTML: elements whose content is no markup, that show no text of the page, that
#: never have content, and that start a new block.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("noscript template svg math select object audio video canvas button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()) | UNSEEN
#: Elements that tell the part of a page.
PARTS = frozenset("article aside footer form header main nav section".split())
#: A start closes these when they are open on top of it.
NEIGHBOURS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"),
              "tr": ("td", "th", "tr"), "option": ("option",)}

OPENING = re.compile(r"<(?=[a-zA-Z!?/])")
TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|data-main)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Block(NamedTuple):
    text: str
    around: frozenset  # 'in:tag' and 'as:word' of the elements around it
    near: frozenset    # 'near:word' of the closest element with class or id words, 'part:tag' of the closest part
    element: str       # the nearest block element
    container: int     # number of the element that holds the nearest one
    linked: float      # share of link characters
    main: bool         # marked as main text (labelled pages only)


class Frame(NamedTuple):
    name: str
    around: frozenset
    near: frozenset
    part: str
    number: int
    parent: int
    main: bool
    unseen: bool


def leaf_blocks(page: str, known=None) -> list[Block]:
    """The blocks with text, in page order. ``known``: only these features are kept."""
    out: list[Block] = []
    stack = [Frame("body", frozenset(), frozenset(), "none", 0, 0, False, False)]
    counts: dict[str, int] = {}
    held: list[str] = []
    chars = linked = links = number = 0

    def flush():
        nonlocal held, chars, linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                f = stack[-1]
                out.append(Block(text, f.around, f.near | {f"part:{f.part}"}, f.name, f.parent, linked / max(chars, 1), f.main))
            held, chars, linked = [], 0, 0

    def pop():
        counts[stack.pop().name] -= 1

    pos, end = 0, len(page)
    while pos < end:
        m = OPENING.search(page, pos)
        at = m.start() if m else end
        if at > pos and not stack[-1].unseen:
            piece = page[pos:at]
            if "&" in piece:
                piece = entities.unescape(piece)
            held.append(piece)
            size = len(piece) - piece.count(" ")
            chars += size
            linked += size if links else 0
        if m is None:
            break
        sign = page[at + 1]
        letter = page[at + 2:at + 3] if sign == "/" else sign
        tagged = letter.isascii() and letter.isalpha()
        t = TAG.match(page, at) if tagged else None
        if page.startswith("<!--", at):
            close = at + 4 if page.startswith((">", "->"), at + 4) else page.find("-->", at + 4)
            pos = page.find(">", close) + 1 if close >= 0 else 0
        elif tagged:
            pos = t.end() if t else 0
        else:
            pos = page.find(">", at) + 1
        if not pos:  # an unfinished tag or comment
            break
        if not tagged:
            continue
        name, closing = t[1].lower(), sign == "/"
        if name in RAW:
            if not closing:
                close = RAW_END[name].search(page, pos)
                if close is None:
                    break
                pos = close.start()
            continue
        if name == "a":
            links = 0 if closing else 1
        elif name == "br" or name == "wbr":
            held.append(" " if name == "br" else "")
        elif name == "hr":
            flush()
        elif name in BLOCKS:
            flush()
            if closing:
                if counts.get(name, 0):
                    while stack[-1].name != name:
                        pop()
                    pop()
                continue
            if stack[-1].name == "p":
                pop()
            while stack[-1].name in NEIGHBOURS.get(name, ()):
                pop()
            top = stack[-1]
            fresh, words, main = {f"in:{name}"}, set(), top.main
            if t[2]:
                for key, value in ATTRIBUTE.findall(t[2]):
                    value = value.strip("\"'")
                    if key.lower() == "data-main":
                        main = value == "1"
                    else:
                        words.update(w.lower() for w in WORD.findall(value))
            fresh.update(f"as:{w}" for w in words)
            near = frozenset(f"near:{w}" for w in words) or top.near
            if known is not None:
                fresh, near = fresh & known, near & known
            number += 1
            counts[name] = counts.get(name, 0) + 1
            stack.append(Frame(name, top.around if fresh <= top.around else top.around | fresh, near, name if name in PARTS else top.part,
                               number, top.number, main, top.unseen or name in UNSEEN))
    flush()
    return out

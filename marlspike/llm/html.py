"""Pages as trees of block elements: a tolerant tokenizer in one pass, and what each block says."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

from xxhash import xxh3_64_intdigest

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "noscript", "template", "iframe", "title", "textarea", "svg", "object", "canvas", "xmp", "noembed", "noframes")}

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that a start tag ends when they are open: the tag, what it ends, and what bounds the search.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
HIDDEN = "#hidden"
NOISE_TAGS = frozenset("nav footer aside form button select fieldset dialog menu datalist".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation "
    "newsletter notice notices overlay pager pagination popup promo promotion recommended related replies reply respond share sharing sidebar signup skyscraper social sponsor sponsored subscribe toolbar widget widgets".split()
)
MAIN_WORDS = frozenset("article articlebody content entry main post story".split())


def number(text: str) -> int:
    return xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


@dataclass(slots=True)
class Node:
    tag: str
    path: int  # the hash of the parent's path and the own style
    parent: Node | None
    noise: bool = False
    landmark: int = 0  # 2: article, 1: main; inherited
    mark: Node | None = None  # the article or main element that this is or lies in
    children: list[str] = field(default_factory=list)


@dataclass(slots=True)
class Block:
    node: Node
    text: str


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(source)} if source.strip() else {}


def _hidden(attributes: dict[str, str]) -> bool:
    style = attributes.get("style", "").replace(" ", "").lower()
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


def _classify(tag: str, attributes: dict[str, str], parent: Node | None) -> tuple[bool, int, str]:
    """Whether the element is furniture by its own name, its landmark, and its style."""
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower() if attributes else ""
    words = set(_WORD.findall(named))
    above = parent.landmark if parent else 0
    role = attributes.get("role", "").lower() if attributes else ""
    noise = tag in NOISE_TAGS or role in NOISE_ROLES or (bool(words & NOISE_WORDS) and tag not in ("body", "html"))
    if tag == "header" or "header" in words:
        noise = noise or (not above and tag not in ("body", "html"))
    noise = noise or (bool(attributes) and _hidden(attributes))
    if tag == "article" or attributes.get("itemprop") == "articleBody":
        landmark = 2
    elif tag == "main" or role == "main":
        landmark = max(1, above)
    else:
        landmark = above
    style = re.sub(r"[0-9]+", "0", ".".join([tag, *sorted(words)])) if words else tag
    return noise, landmark, style


def blocks(source: str | None) -> tuple[list[Node], list[Block]]:
    """All block elements, parents first, and all blocks of text in page order.

    An inline element that is furniture by name goes where it has a block to itself; beside other text,
    as a link in a sentence, it's part of that text. Hidden inline elements go anywhere.
    """
    source = source or ""
    root = Node("#page", 0, None)
    stack, nodes, out, held = [root], [root], [], []
    inline: list[tuple[str, Node]] = []  # open inline elements that are furniture: their stand-in nodes

    def flush() -> None:
        if held:
            own = stack[-1]
            seen = [(node, piece) for node, piece in held if node.tag != HIDDEN]
            if not any(node is own and piece.strip() for node, piece in seen):
                own = next((node for node, piece in seen if piece.strip()), own)  # furniture alone
            text = " ".join(unescape("".join(piece for _, piece in seen)).split())
            if text:
                out.append(Block(own, text))
            held.clear()

    def end(k: int) -> None:
        flush()
        del stack[k:]
        inline.clear()

    at, size = 0, len(source)
    while at < size:
        m = _TOKEN.search(source, at)
        if m is None:
            held.append((inline[-1][1] if inline else stack[-1], source[at:]))
            break
        if m.start() > at:
            held.append((inline[-1][1] if inline else stack[-1], source[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                if any(t == tag for t, _ in inline):
                    while inline.pop()[0] != tag:
                        pass
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    end(k)
                    break
            else:
                flush()
            continue
        if tag == "br":
            held.append((inline[-1][1] if inline else stack[-1], " "))
            continue
        if tag in _RAW:
            close = _RAW[tag].search(source, at)
            at = close.start() if close else size
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        attributes = _attributes(m[3])
        if tag in INLINE:
            above = inline[-1][1] if inline else stack[-1]
            if attributes or inline:
                noise, _, style = _classify(tag, attributes, above)
                if noise:
                    hidden = above.tag == HIDDEN or _hidden(attributes)
                    node = Node(HIDDEN if hidden else tag, number(f"{above.path}/{style}"), above, True, above.landmark, above.mark)
                    nodes.append(node)
                    inline.append((tag, node))
                elif inline:
                    inline.append((tag, above))
            continue
        flush()
        inline.clear()
        closes, bounds = ENDS.get(tag, ((), ()))
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in closes:
                end(k)
            elif stack[k].tag == "p":
                end(k)
            elif stack[k].tag in bounds or stack[k].tag not in ("td", "th", "p"):
                if not closes or stack[k].tag in bounds:
                    break
        above = stack[-1]
        noise, landmark, style = _classify(tag, attributes, above)
        node = Node(tag, number(f"{above.path}/{style}"), above, noise or above.noise, landmark)
        node.mark = (above.mark if landmark and landmark == above.landmark else node) if landmark else None
        above.children.append(style)
        nodes.append(node)
        if not m[3].endswith("/") or tag in ("p", "div"):
            stack.append(node)
    flush()
    return nodes, out

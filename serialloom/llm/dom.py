"""Pages as flat lists of nodes and text pieces."""

import re
from functools import lru_cache
from html import unescape

_TAG = re.compile(
    r"""<(?: !--.*?(?:--!?>|\Z) | [!?][^>]*(?:>|\Z)
      | (?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
      | (?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z) )""",
    re.S | re.X,
)
_ATTR = re.compile(r"""([a-zA-Z][\w:-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: No tag stands inside them; without an end tag they go to the end of the page.
RAW = frozenset("script style textarea title iframe".split())
#: Elements whose text is for no reader. Without an end tag, a block or their parent's end closes them.
DROPPED = frozenset("noscript template object svg select button canvas".split())
_NESTED = frozenset("template object svg".split())
#: An end tag inside them closes nothing outside.
_CLOSED_OFF = frozenset("template object svg select".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var".split()
)
#: What an opening tag closes, if it is open inside the nearest list, table or section.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
_BARRIER = frozenset("ul ol dl table tbody thead tfoot body html article section div main aside nav".split())


@lru_cache(maxsize=20_000)
def _attributes(raw: str) -> tuple[tuple[str, ...], bool]:
    """Lower-case words of the naming attributes, and whether the page marks its main text (training pages do)."""
    tokens, marked = [], False
    for name, *values in _ATTR.findall(raw):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            tokens += [t.lower() for t in _TOKEN.findall(value)]
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            tokens.append("hidden")
        elif name == "data-main-text":
            marked = True
    return tuple(dict.fromkeys(tokens)), marked


OPEN, SHUT = 1, 2


def _with_end(html: str, name: str) -> set[int]:
    """Where tags of this name start that have an end tag of their own."""
    open_tags, found = [], set()
    for m in re.compile(rf"<(/?){name}(?=[\s/>])", re.I).finditer(html):
        if m[1]:
            if open_tags:
                found.add(open_tags.pop())
            continue
        if name not in _NESTED:
            open_tags.clear()
        open_tags.append(m.start())
    return found


class Page:
    """Nodes in page order (a parent before its children) and text pieces.

    tags, parents, depths and tokens have an entry per node; node 0 is the page. A piece is
    (block, node, text, in_link): pieces of one block stand in one line of text. marked has
    the nodes that training pages mark.
    """

    def __init__(self, html: str):
        self.tags, self.parents, self.depths, self.tokens = ["#page"], [-1], [0], [()]
        self.pieces: list[tuple[int, int, str, bool]] = []
        self.marked: set[int] = set()
        self._read(html)

    def _read(self, html: str):
        # tag, node, starts a block, 0 or how its text is dropped: OPEN without an end tag, SHUT with one
        stack: list[tuple[str, int, bool, int]] = [("#page", 0, False, 0)]
        block = links = pos = dropped = foreign = 0
        pieces, shut = self.pieces, {}
        loose: list[int] = []  # places in the stack that a block ends, from the outermost on

        def text(a: int, b: int):
            if b > a and not dropped:
                said = html[a:b]
                pieces.append((block, stack[-1][1], unescape(said) if "&" in said else said, links > 0))

        def pop(to: int):
            nonlocal links, block, dropped, foreign
            while len(stack) > to:
                tag, _, blocky, drops = stack.pop()
                links -= tag == "a"
                block += blocky
                dropped -= drops > 0
                foreign -= tag in ("svg", "math")
            while loose and loose[-1] >= to:
                loose.pop()

        search = _TAG.search
        while True:
            m = search(html, pos)
            if m is None:
                text(pos, len(html))
                return
            text(pos, m.start())
            pos = m.end()
            name = m["name"] or m["name2"]
            if name is None:
                continue
            name = name.lower()
            if m["end"] or m["end2"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        pop(i)
                        break
                    if stack[i][3] == SHUT and stack[i][0] in _CLOSED_OFF:
                        break
                else:
                    block += name not in INLINE and not dropped
                continue
            if name in ("br", "hr"):
                block += not dropped
                continue
            raw = m["attrs"] if m["name"] else m["attrs2"]
            if name in VOID:
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, pos)
                pos = end.end() if end else len(html)
                block += not dropped
                continue
            if (foreign or name in ("svg", "math")) and raw.rstrip().endswith("/"):
                continue
            if loose and name in _ENDS_P:
                pop(loose[0])
            elif loose and name in DROPPED and name not in _NESTED:
                at = next((i for i in loose if stack[i][0] == name), None)
                if at is not None:
                    pop(at)
            if name in DROPPED:
                if name not in shut:
                    shut[name] = _with_end(html, name)
                block += name in ("noscript", "template", "object", "canvas") and not dropped
                if m.start() not in shut[name]:
                    loose.append(len(stack))
                stack.append((name, stack[-1][1], False, SHUT if m.start() in shut[name] else OPEN))
                dropped += 1
                foreign += name == "svg"
                continue
            if name in _ENDS_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        pop(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
            if name in CLOSES:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in CLOSES[name]:
                        pop(i)
                        break
                    if stack[i][3] == SHUT or stack[i][0] in _BARRIER or stack[i][0] == "tr" and name in ("td", "th"):
                        break
            if name in ("html", "body", "head"):
                continue
            if dropped or foreign or name == "math":  # inside, no nodes and no blocks
                if name == "math":
                    loose.append(len(stack))
                stack.append((name, stack[-1][1], False, 0))
                links += name == "a"
                foreign += name in ("svg", "math")
                continue
            tokens, marked = _attributes(raw) if raw.strip() else ((), False)
            blocky = name not in INLINE
            node = stack[-1][1]
            if blocky or tokens and name != "a":
                self.tags.append(name)
                self.parents.append(node)
                self.depths.append(self.depths[node] + 1)
                self.tokens.append(tokens)
                node = len(self.tags) - 1
                if marked:
                    self.marked.add(node)
            block += blocky
            links += name == "a"
            stack.append((name, node, blocky, 0))

    def text(self, kept) -> str:
        """White space inside a block as one space, blocks by one space; only pieces of kept nodes."""
        out, line, last = [], [], -1
        for block, node, said, _ in self.pieces:
            if block != last:
                out += "".join(line).split()
                line, last = [], block
            if kept[node]:
                line.append(said)
        out += "".join(line).split()
        return " ".join(out)

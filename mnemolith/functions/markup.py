"""HTML to Markdown: a tokenizer over tags and texts, and a stack of open elements."""

from __future__ import annotations

import html
import re

#: Elements whose contents say nothing, that have no end, that stand in blocks of their own, and that mark a phrase.
SKIPPED = {"head", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "textarea", "select", "audio", "video"}
VOID = {"br", "hr", "img", "meta", "link", "input", "base", "area", "col", "embed", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "ul"}
MARKS = {"b": "**", "strong": "**", "i": "_", "em": "_", "s": "~~", "strike": "~~", "del": "~~"}
#: Open elements beyond this many are read as if their tags were not there.
MOST_OPEN = 256

# A quoted value may hold > but ends before the next <, so that a missing quote costs no second look at the page.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+))""")
_SPECIAL = re.compile(r"([\\`*_~\[\]])")
_LEADING = re.compile(r"^([#>=+-])(?=\s)|^(\d+)(?=[.)]\s)")
#: What an open tag ends (up to the elements after it): items, rows, cells, terms and paragraphs may lack their ends.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
_PARAGRAPH = ({"p"}, {"table", "td", "th", "li", "blockquote"})
#: A line's end within code, which is neither folded nor trimmed.
_KEPT = "\x00"


class _Open:
    """An element that is open: its name, attributes, pieces so far, and how many items, rows or cells it has."""

    __slots__ = ("tag", "attributes", "pieces", "n")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.pieces, self.n = tag, attributes, [], 0


def _line(text: str) -> str:
    return re.sub(r"[ \n\x00]+", " ", text).strip()


def _indented(text: str, by: str) -> str:
    return text.replace("\n", "\n" + by).replace(_KEPT, _KEPT + by)


class _Page:
    def __init__(self) -> None:
        self.open, self.beyond = [_Open("", {})], 0
        #: How many elements are open that are skipped, in which lines are kept, and that are code.
        self.skipped = self.kept = self.code = 0

    def count(self, tag: str, by: int) -> None:
        self.skipped += by * (tag in SKIPPED)
        self.kept += by * (tag == "pre")
        self.code += by * (tag == "code")

    def within(self, tags: set[str]) -> _Open | None:
        return next((e for e in reversed(self.open) if e.tag in tags), None)

    def add(self, text: str) -> None:
        self.open[-1].pieces.append(text)

    def at_start(self) -> bool:
        """No space is wanted here: a line or block begins, or a space is there already."""
        for e in reversed(self.open):
            if e.pieces:
                return e.pieces[-1][-1:] in ("", " ", "\n")
            if e.tag in BLOCKS or e.tag in ("td", "th", ""):
                return True
        return True

    def text(self, raw: str) -> None:
        if self.skipped:
            return
        t = html.unescape(raw).replace("\x00", "")
        if self.kept:
            return self.add(t.replace("\r\n", "\n").replace("\n", _KEPT))
        t = re.sub(r"\s+", " ", t)
        if not self.code:
            t = _SPECIAL.sub(r"\\\1", t)
        if self.at_start():
            t = t.lstrip(" ")
            if not self.code and (not self.open[-1].pieces or self.open[-1].pieces[-1].endswith("\n")):
                t = _LEADING.sub(lambda m: "\\" + m[1] if m[1] else m[2] + "\\", t)
        if t:
            self.add(t)

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in VOID:
            if not self.skipped:
                self.add({"br": _KEPT if self.kept else "  \n", "hr": "\n\n---\n\n"}.get(tag, ""))
                if tag == "img" and attributes.get("src"):
                    self.add(f"![{_line(attributes.get('alt', ''))}]({attributes['src']})")
            return
        if tag in _ENDS:
            self.close(*_ENDS[tag])
        if tag in BLOCKS:
            self.close(*_PARAGRAPH)
        if len(self.open) > MOST_OPEN:
            self.beyond += 1
        else:
            self.open.append(_Open(tag, attributes))
            self.count(tag, 1)

    def close(self, tags: set[str], bound: set[str]) -> None:
        """Ends the last open one of the tags with all in it, if there is one this side of the bound."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                while len(self.open) > k:
                    self.pop()
                return
            if self.open[k].tag in bound:
                return

    def end(self, tag: str) -> None:
        if self.beyond:
            self.beyond -= 1
        else:
            self.close({tag}, {"td", "th", "table"} - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else set())

    def pop(self) -> None:
        e = self.open.pop()
        self.count(e.tag, -1)
        text = self.rendered(e.tag, e.attributes, "".join(e.pieces), e)
        if text:
            self.add(text)

    def rendered(self, tag: str, attributes: dict[str, str], inside: str, e: _Open) -> str:
        if tag in SKIPPED:
            return ""
        if tag in MARKS or tag == "code":
            return inside if self.kept else "\n".join(self.marked(x, MARKS.get(tag)) for x in inside.split("\n"))
        if tag == "a":
            said, to = _line(inside), attributes.get("href", "").strip()
            return (inside[:1] if inside[:1] == " " else "") + f"[{said}]({to})" + (" " if inside[1:].endswith(" ") else "") if said and to else inside
        if tag in ("td", "th"):
            row = self.within({"tr"})
            if row:
                row.n += 1
            return _line(inside).replace("|", "\\|") + " | "
        if tag == "tr":
            table = self.within({"table"})
            if not e.n:
                return f"\n\n{inside}\n\n" if inside.strip() else ""
            head = table is not None and table.n == 0
            if table:
                table.n += 1
            return f"| {inside.strip(' ')}\n" + (f"|{' --- |' * e.n}\n" if head else "")
        if tag not in BLOCKS or (tag != "pre" and not inside.strip()):
            return inside
        if tag == "pre":
            return f"\n\n```{_KEPT}{inside.strip(_KEPT)}{_KEPT}```\n\n" if inside.strip(_KEPT + " ") else ""
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return f"\n\n{'#' * int(tag[1])} {_line(inside)}\n\n"
        if tag == "li":
            lists = self.within({"ul", "ol"})
            if lists:
                lists.n += 1
            mark = f"{lists.n}. " if lists and lists.tag == "ol" else "* "
            return "\n" + mark + _indented(re.sub(r"\n{3,}", "\n\n", inside.strip(" \n")), " " * (3 if mark != "* " else 2))
        if tag in ("ul", "ol"):
            return f"\n{inside.strip(chr(10))}\n" if self.within({"li"}) else f"\n\n{inside.strip(chr(10))}\n\n"
        if tag == "blockquote":
            quoted = re.sub(r"\n{3,}", "\n\n", inside.strip(" \n"))
            return "\n\n> " + _indented(quoted, "> ") + "\n\n"
        return f"\n\n{inside.strip(' ')}\n\n"

    @staticmethod
    def marked(text: str, mark: str | None) -> str:
        """The text between marks, with the spaces around it outside."""
        core = text.strip(" ")
        if not core:
            return text
        if mark is None:
            mark = "`" * (1 + max(map(len, re.findall("`+", core)), default=0))
        k = text.index(core)
        return text[:k] + mark + core + mark + text[k + len(core) :]


def markdown(page: str | None) -> str | None:
    """The page as Markdown: headings, lists, links, images, emphasis, code, quotes and tables; null stays null.

    What may lack its end (items, rows, cells, paragraphs) is ended by what follows; other elements end with their parents;
    ends of what isn't open are passed over. Signs that Markdown would read are escaped.
    """
    if page is None:
        return None
    p, at = _Page(), 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            p.text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            p.end(tag)
            continue
        rest = m[3] if m[2] else m[6]
        p.start(tag, {k.lower(): html.unescape(a or b or c) for k, a, b, c in reversed(_ATTRIBUTE.findall(rest))} if tag in ("a", "img") else {})
        if tag in ("script", "style"):
            end = re.compile(rf"</{tag}\b[^<>]*>|\Z", re.I).search(page, at)
            p.end(tag)
            at = end.end()
    p.text(page[at:])
    while len(p.open) > 1:
        p.pop()
    out = re.sub(r"\n{3,}", "\n\n", re.sub(r"\n[ \n]*\n", lambda x: "\n\n", "".join(p.open[0].pieces)))
    return out.strip(" \n").replace(_KEPT, "\n")

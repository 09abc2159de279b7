"""Markdown rendered to HTML, which the HTML operator then reads.

Blocks: every line is offered to the open containers (quotes and list items) in turn, which take their prefix off or close;
what is left of the line continues the open leaf (paragraph, code, table, raw HTML) or starts a block. Inlines: one scan
from left to right makes tokens; runs of ``*`` and ``_`` and brackets wait on a stack until their closer is met, as the
CommonMark text describes it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import escape

# Tags that begin a block of raw HTML.
RAW_TAGS = frozenset(
    "address article aside blockquote body center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)

# --- inlines ----------------------------------------------------------------------------------------------------------

PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
URI = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")
TAG = re.compile(r"</?[A-Za-z][\w-]*(?:\s[^<>]*)?/?>|<!--.*?-->", re.DOTALL)
TARGET = re.compile(r"\(\s*(?:<([^<>\n]*)>|([^\s()<>]*(?:\([^\s()]*\)[^\s()]*)*))(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)")


@dataclass
class Mark:
    """A token that may yet open or close: a run of ``*`` or ``_``, or a bracket."""

    char: str
    size: int
    at: int  # its place among the tokens
    opens: bool
    closes: bool


def inline(text: str) -> str:
    out: list[str] = []
    marks: list[Mark] = []
    at, n = 0, len(text)
    while at < n:
        c = text[at]
        if c == "\\" and at + 1 < n:
            following = text[at + 1]
            if following == "\n":
                out.append("<br />\n")
            else:
                out.append(escape(following if following in PUNCTUATION else c + following, quote=False))
            at += 2
        elif c == "`":
            size = run_length(text, at, c)
            end = closing_ticks(text, at + size, size)
            if end < 0:
                out.append(c * size)
                at += size
            else:
                out.append(f"<code>{escape(text[at + size : end].strip())}</code>")
                at = end + size
        elif c == "<" and (found := URI.match(text, at)):
            out.append(f'<a href="{escape(found[1])}">{escape(found[1])}</a>')
            at = found.end()
        elif c == "<" and (found := TAG.match(text, at)):
            out.append(found[0])
            at = found.end()
        elif c in "*_":
            size = run_length(text, at, c)
            before, after = text[at - 1 : at] if at else " ", text[at + size : at + size + 1] or " "
            left = not after.isspace() and (after not in PUNCTUATION or before.isspace() or before in PUNCTUATION)
            right = not before.isspace() and (before not in PUNCTUATION or after.isspace() or after in PUNCTUATION)
            inner = left and right and (before not in PUNCTUATION and after not in PUNCTUATION)
            whole = c == "_" or size == 1  # single marks within a word stand for themselves
            marks.append(Mark(c, size, len(out), left and not (inner and whole), right and not (inner and whole)))
            out.append(c * size)
            at += size
        elif c == "[" or text.startswith("![", at):
            size = 1 if c == "[" else 2
            marks.append(Mark(text[at : at + size], size, len(out), True, False))
            out.append(text[at : at + size])
            at += size
        elif c == "]":
            at = close_bracket(text, at, out, marks)
        elif c == "\n":
            hard = bool(out) and out[-1].endswith("  ")
            if hard:
                out[-1] = out[-1].rstrip(" ")
            out.append("<br />\n" if hard else "\n")
            at += 1
        else:
            end = at + 1
            while end < n and text[end] not in "\\`<*_[]!\n":
                end += 1
            out.append(escape(text[at:end], quote=False))
            at = end
    emphasize(out, marks)
    return "".join(out)


def run_length(text: str, at: int, char: str) -> int:
    end = at
    while end < len(text) and text[end] == char:
        end += 1
    return end - at


def closing_ticks(text: str, at: int, size: int) -> int:
    while (at := text.find("`", at)) >= 0:
        found = run_length(text, at, "`")
        if found == size:
            return at
        at += found
    return -1


def close_bracket(text: str, at: int, out: list[str], marks: list[Mark]) -> int:
    """What a closing bracket makes of the last open one: a link, an image, or just itself."""
    k = next((k for k in range(len(marks) - 1, -1, -1) if marks[k].char in ("[", "![")), None)
    target = TARGET.match(text, at + 1) if k is not None else None
    if target is None:
        if k is not None:
            del marks[k]
        out.append("]")
        return at + 1
    opener, url = marks[k], escape(target[1] if target[1] is not None else target[2])
    emphasize(out, marks[k + 1 :])
    del marks[k:]
    shown = "".join(out[opener.at + 1 :])
    if opener.char == "[" and not shown:
        out.append("]")
        return at + 1
    del out[opener.at :]
    if opener.char == "[":
        out.append(f'<a href="{url}">{shown}</a>')
    else:
        out.append(f'<img alt="{escape(re.sub("<[^>]*>", "", shown).replace("&amp;", "&"))}" src="{url}" />')
    return target.end()


def emphasize(out: list[str], marks: list[Mark]) -> None:
    """Turns matching runs into tags, innermost first; what has no partner stays text."""
    waiting: list[Mark] = []
    for closer in marks:
        while closer.closes and closer.size:
            k = next((k for k in range(len(waiting) - 1, -1, -1) if waiting[k].char == closer.char and waiting[k].size), None)
            if k is None:
                break
            opener = waiting[k]
            used = 2 if opener.size > 1 and closer.size > 1 else 1
            tag = "strong" if used == 2 else "em"
            opener.size -= used
            closer.size -= used
            end, start = out[opener.at].rfind(opener.char) + 1, out[closer.at].find(closer.char)
            out[opener.at] = out[opener.at][: end - used] + f"<{tag}>" + out[opener.at][end:]
            out[closer.at] = out[closer.at][:start] + f"</{tag}>" + out[closer.at][start + used :]
            del waiting[k + 1 :]
        if closer.opens and closer.size and closer.char in "*_":
            waiting.append(closer)


# --- blocks -----------------------------------------------------------------------------------------------------------

ITEM = re.compile(r"( {0,})([-+*]|[0-9]{1,9}[.)])( +|$)")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,}) *([^\s`]*)[^`]*$")


@dataclass
class Block:
    """A node of the document: a container of blocks, or a leaf of lines."""

    kind: str
    lines: list[str] = field(default_factory=list)
    inner: list[Block] = field(default_factory=list)
    indent: int = 0  # of an item's content; of a fence
    start: int = 0  # the column of an item's mark
    note: str = ""  # a fence and its language, a heading's level, a list's kind
    done: bool = False


def blank_width(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def thematic(line: str) -> bool:
    marks = line.replace(" ", "")
    return blank_width(line) < 4 and len(marks) > 2 and marks[0] in "-*_" and marks == marks[0] * len(marks)


def atx(line: str) -> tuple[int, str] | None:
    """(level, text) of a heading of number signs."""
    bare = line.strip()
    level = run_length(bare, 0, "#")
    if blank_width(line) > 3 or not 0 < level < 7 or bare[level : level + 1] not in ("", " "):
        return None
    text = bare[level:].strip()
    cut = text.rstrip("#")
    return level, cut.rstrip() if not cut or cut.endswith(" ") else text


def raw_start(line: str) -> bool:
    bare = line.lstrip(" ")
    if blank_width(line) > 3 or not bare.startswith("<"):
        return False
    name = re.match(r"</?([A-Za-z0-9]+)\b", bare)
    return bare.startswith("<!--") or bool(name and name[1].lower() in RAW_TAGS)


def split_row(line: str) -> list[str]:
    """The cells of a table's line: cut at bars that no backslash escapes."""
    cells, cell, escaped = [], "", False
    for c in line.strip():
        if c == "|" and not escaped:
            cells.append(cell)
            cell = ""
        else:
            cell = cell[:-1] + c if c == "|" else cell + c
        escaped = c == "\\" and not escaped
    cells.append(cell)
    if not cells[0].strip():
        del cells[0]
    if len(cells) > 1 and not cells[-1].strip():
        del cells[-1]
    return [c.strip() for c in cells]


def is_delimiter_row(line: str) -> bool:
    cells = [c.strip() for c in line.strip().strip("|").split("|")]
    return "-" in line and all(c and not c.strip(":").strip("-") and "-" in c and ":" not in c[1:-1] for c in cells)


class Document:
    """Builds the tree line by line; ``open`` is the path of containers that take the next line, ``leaf`` their open leaf."""

    def __init__(self):
        self.root = Block("document")
        self.open: list[Block] = [self.root]
        self.leaf: Block | None = None
        self.after_blank = False

    def add(self, block: Block, leaf: bool = True) -> None:
        self.open[-1].inner.append(block)
        self.leaf = block if leaf and not block.done else None
        if not leaf:
            self.open.append(block)

    def close_to(self, depth: int) -> None:
        if len(self.open) > depth:
            del self.open[depth:]
            self.leaf = None

    def feed(self, line: str) -> None:
        depth = 1
        for k, box in enumerate(self.open[1:], start=1):  # which containers the line is in
            if box.kind == "quote":
                if blank_width(line) > 3 or not line.lstrip(" ").startswith(">"):
                    break
                line = line.lstrip(" ")[1:].removeprefix(" ")
            elif box.kind == "item":
                if line.strip() and blank_width(line) < box.indent and blank_width(line) <= box.start:
                    break
                line = line[min(blank_width(line), box.indent) :] if line.strip() else ""
            depth = k + 1
        if not line.strip():
            self.blank(line, depth)
            return
        leaf = self.leaf
        if depth < len(self.open):
            if leaf and leaf.kind == "paragraph" and not self.starts(line) and not self.after_blank:
                leaf.lines.append(line)  # a paragraph goes on without the marks of its containers
                return
            self.close_to(depth)
            leaf = self.leaf
        if leaf is not None and self.goes_on(leaf, line):
            self.after_blank = False
            return
        self.begin(line)
        self.after_blank = False

    def blank(self, line: str, depth: int) -> None:
        leaf = self.leaf
        if leaf is not None and leaf.kind in ("fence", "indented"):
            if depth == len(self.open):
                leaf.lines.append(line)
                return
        else:
            self.leaf = None
        if any(b.kind == "quote" for b in self.open[depth:]):
            self.close_to(depth)
        self.after_blank = True

    def starts(self, line: str) -> bool:
        """Whether a line begins a block that may interrupt a paragraph."""
        item = ITEM.match(line)
        return bool(
            atx(line) or thematic(line) or FENCE.match(line) or raw_start(line) or line.lstrip(" ").startswith(">") or (item and item[3])
        )

    @staticmethod
    def same_list(box: Block, line: str) -> bool:
        found = ITEM.match(line)
        return bool(found) and box.kind == "list" and box.start == len(found[1]) and box.note == ("ol" if found[2][0].isdigit() else "ul")

    def goes_on(self, leaf: Block, line: str) -> bool:
        if leaf.kind == "fence":
            bare = line.strip()
            if bare.startswith(leaf.note) and not bare.strip(leaf.note[0]):
                self.leaf = None
            else:
                leaf.lines.append(line[min(blank_width(line), leaf.indent) :])
            return True
        if leaf.kind == "indented":
            if blank_width(line) > 3:
                leaf.lines.append(line[4:])
                return True
        elif leaf.kind == "raw":
            leaf.lines.append(line)
            return True
        elif leaf.kind == "table":
            if "|" in line:
                leaf.lines.append(line)
                return True
        elif leaf.kind == "paragraph":
            mark = line.strip()
            if blank_width(line) < 4 and mark in ("=" * len(mark), "-" * len(mark)):
                leaf.kind, leaf.note = "heading", "1" if mark[0] == "=" else "2"
                self.leaf = None
                return True
            if len(leaf.lines) == 1 and "|" in leaf.lines[0] and is_delimiter_row(line):
                leaf.kind = "table"
                return True
            if not self.starts(line):
                leaf.lines.append(line)
                return True
        self.leaf = None
        return False

    def begin(self, line: str) -> None:
        item = ITEM.match(line)
        while self.open[-1].kind == "list" and not self.same_list(self.open[-1], line):
            self.open.pop()
        if thematic(line):
            self.add(Block("rule", done=True))
        elif item and (item[3] or len(line) == item.end()) and (blank_width(line) < 4 or self.open[-1].kind == "list"):
            self.begin_item(line, item)
        elif blank_width(line) > 3:
            self.add(Block("indented", [line[4:]]))
        elif heading := atx(line):
            self.add(Block("heading", [heading[1]], note=str(heading[0]), done=True))
        elif fence := FENCE.match(line):
            self.add(Block("fence", note=fence[1], indent=blank_width(line), start=0))
            self.leaf.inner.append(Block("language", [fence[2]]))
        elif line.lstrip(" ").startswith(">"):
            self.add(Block("quote"), leaf=False)
            rest = line.lstrip(" ")[1:].removeprefix(" ")
            if rest.strip():
                self.begin(rest)
        elif raw_start(line):
            self.add(Block("raw", [line]))
        else:
            self.add(Block("paragraph", [line]))

    def begin_item(self, line: str, item: re.Match) -> None:
        kind = "ol" if item[2][0].isdigit() else "ul"
        if self.open[-1].kind != "list":
            self.add(Block("list", note=kind, start=len(item[1])), leaf=False)
        self.add(Block("item", indent=item.end(), start=len(item[1])), leaf=False)
        rest = line[item.end() :]
        if rest.strip():
            self.begin(rest)


def code_html(lines: list[str], language: str) -> str:
    name = f' class="language-{escape(language)}"' if language else ""
    return f"<pre><code{name}>{escape(chr(10).join(lines))}\n</code></pre>"


def paragraph_text(lines: list[str]) -> str:
    """Lines without their margins; two blanks at a line's end, which break it, stay."""
    shown = [x.strip() + ("  " if x.endswith("  ") else "") for x in lines]
    return inline("\n".join(shown).rstrip(" "))


def render(block: Block) -> str:
    kind, lines = block.kind, block.lines
    if kind == "document":
        return "\n".join(map(render, block.inner))
    if kind == "paragraph":
        return f"<p>{paragraph_text(lines)}</p>"
    if kind == "heading":
        return f"<h{block.note}>{inline(' '.join(x.strip() for x in lines))}</h{block.note}>"
    if kind == "rule":
        return "<hr />"
    if kind == "fence":
        return code_html(lines, block.inner[0].lines[0])
    if kind == "indented":
        last = max(k for k, x in enumerate(lines) if x.strip()) + 1
        return code_html(lines[:last], "")
    if kind == "raw":
        return "\n".join(lines)
    if kind == "quote":
        return "\n".join(["<blockquote>", *map(render, block.inner), "</blockquote>"])
    if kind == "list":
        return "\n".join([f"<{block.note}>", *map(render, block.inner), f"</{block.note}>"])
    if kind == "item":
        first = block.inner[:1] if block.inner and block.inner[0].kind == "paragraph" else []
        rest = [render(b) for b in block.inner[len(first) :]]
        return "<li>" + "\n".join([*(paragraph_text(b.lines) for b in first), *rest]) + "</li>"
    head, *body = [split_row(x) for x in lines]
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{inline(c)}</{tag}>" for c in cells) + "</tr>"
    filled = ((r + [""] * len(head))[: len(head)] for r in body)
    return f"<table><thead>{row(head, 'th')}</thead><tbody>{''.join(row(r, 'td') for r in filled)}</tbody></table>"


def markdown_to_html(text: str) -> str:
    document = Document()
    for line in re.split(r"\r\n|\r|\n", text.expandtabs(4)):
        document.feed(line)
    return render(document.root)

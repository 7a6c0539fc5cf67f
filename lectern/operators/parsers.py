"""Line classifiers of the five formats: a text as an ordered list of (kind, text) regions.

Which lines are prose depends on nested, exclusive states with look-ahead, so this is one pass over the lines in
Python, fed by Arrow batches.  A format is a set of *spans* (states that last until a line tells otherwise) and *rules*
(what a single line is), tried in order; the reader below runs any of them.

Defined results: null gives null and an empty text no regions.  A continuation line under an empty Org list item starts
the item's prose.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from lectern.functions.text import KEPT_ENVIRONMENTS, MARKER, WHITE

PROSE, STRUCTURE, BLANK = "prose", "structure", "blank"
Region = tuple[str, str]

@lru_cache(maxsize=16)
def _marker(name: str) -> re.Pattern:
    name = re.escape(name)
    return re.compile(rf"(?:[#%] \s*)?{name}:(?P<a>on|off)|<!-- \s*{name}:(?P<b>on|off)\s* -->")


def pragma(line: str, name: str = MARKER) -> bool | None:
    """True where a marker switches formatting on, False where it switches it off."""
    if name not in line:
        return None
    m = _marker(name).fullmatch(line.strip(WHITE))
    return None if m is None else (m["a"] or m["b"]) == "on"


def lines_of(text: str) -> list[str]:
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
    else:
        return [p.removesuffix("\r") for p in parts[:-1]] + [parts[-1]]
    return [p.removesuffix("\r") for p in parts]


def indent(line: str) -> int:
    """Leading white space, in bytes."""
    return len(line[: len(line) - len(line.lstrip(WHITE))].encode())


class Reader:
    """Collects regions; prose lines gather until something else comes."""

    def __init__(self) -> None:
        self.regions: list[Region] = []
        self.words: list[str] = []
        self.item_open = False  # a list item whose closing line end is due

    def flush(self) -> None:
        if self.words and (text := " ".join(self.words)):
            self.regions.append((PROSE, text))
        self.words = []
        if self.item_open:
            self.regions.append((STRUCTURE, "\n"))
            self.item_open = False

    def keep(self, line: str) -> None:
        self.flush()
        self.regions.append((STRUCTURE, line + "\n"))

    def blank(self, line: str) -> None:
        self.flush()
        self.regions.append((BLANK, line + "\n"))

    def titled(self, prefix: str, text: str) -> None:
        """Prose on one line after a prefix."""
        self.flush()
        self.regions.append((STRUCTURE, prefix))
        if text:
            self.regions.append((PROSE, text))
        self.regions.append((STRUCTURE, "\n"))


class Syntax:
    """Plain text; other formats add to it.

    ``span`` is what holds at present: a function of a line that says whether the line ends it (``True``), stays in
    it (``False``) or no longer belongs to it (``None``).
    """

    def __init__(self, lines: list[str]) -> None:
        self.lines, self.out = lines, Reader()
        self.span: Callable[[str], bool | None] | None = None

    def read(self, marker: str = MARKER) -> list[Region]:
        off = False
        for i, line in enumerate(self.lines):
            switch = pragma(line, marker)
            if switch is not None:
                off = not switch
                self.out.keep(line)
            elif off:
                self.out.keep(line)
            elif not self._held(line):
                self.line(i, line, line.strip(WHITE))
        self.out.flush()
        return self.out.regions

    def _held(self, line: str) -> bool:
        if self.span is None:
            return False
        state = self.span(line)
        if state is not False:
            self.span = None
        if state is None:
            return False
        self.out.keep(line)
        return True

    def until(self, line: str, ends: Callable[[str], bool]) -> None:
        """Keep this line and all up to one that ``ends``."""
        self.out.keep(line)
        self.span = lambda x: bool(ends(x))

    def line(self, i: int, line: str, bare: str) -> None:
        if not bare:
            self.out.blank(line)
        else:
            self.prose(bare)

    def prose(self, text: str) -> None:
        if text or self.out.words:
            self.out.words.append(text)


# The patterns of the formats' lines below are fixed values: regions depend on them.


class Markdown(Syntax):
    heading = re.compile(r"(#{1,6}\s+)(.*)")
    fence = re.compile(r"`{3,}|~{3,}")
    item = re.compile(r"(\s*(?:[-*+]|\d+[.)]) )(.*)")
    table = re.compile(r"\s*\|.*\|\s*")

    def line(self, i: int, line: str, bare: str) -> None:
        if i == 0 and bare in ("---", "+++"):
            self.until(line, lambda x: x.strip(WHITE) == bare)
        elif m := self.fence.match(line.lstrip(WHITE)):
            mark = m[0]

            def closes(x: str) -> bool:
                other = self.fence.match(x.lstrip(WHITE))
                return bool(other) and other[0][0] == mark[0] and len(other[0]) >= len(mark)

            self.until(line, closes)
        elif not bare:
            self.out.blank(line)
        elif m := self.heading.fullmatch(line):
            self.out.titled(m[1], m[2])
        elif self.table.fullmatch(line):
            self.out.keep(line)
        elif m := self.item.fullmatch(line):
            self.out.flush()
            self.out.regions.append((STRUCTURE, m[1]))
            self.out.item_open = True
            if m[2]:
                self.out.words.append(m[2])
        else:
            self.prose(bare)


class Org(Syntax):
    headline = re.compile(r"(\*+\s+(?:(?:TODO|DONE|NEXT|WAIT)\s+)?)(.*)")
    item = re.compile(r"(\s*(?:[-+]|\d+[.)]) )(.*)")
    begin = re.compile(r"\s*\\begin\{([^}]+)\}")
    end = re.compile(r"\s*\\end\{([^}]+)\}")
    snippet = re.compile(r"@@[a-zA-Z]+:[^@]*@@")
    depth: int | None = None  # where the text of the last list item begins

    def line(self, i: int, line: str, bare: str) -> None:
        start = line.lstrip(WHITE)
        if start[:8].upper() == "#+BEGIN_":
            self.until(line, lambda x: x.lstrip(WHITE)[:6].upper() == "#+END_")
        elif len(bare.encode()) > 2 and bare[0] == bare[-1] == ":":
            self.until(line, lambda x: x.strip(WHITE).upper() == ":END:")
        elif m := self.begin.match(line):
            name = m[1]
            self.until(line, lambda x: (e := self.end.match(x)) is not None and e[1] == name)
        elif bare == "\\[":
            self.until(line, lambda x: x.strip(WHITE) == "\\]")
        elif bare.startswith("@@") and self.snippet.search(bare):
            self.out.keep(line)
        elif not bare:
            self.depth = None
            self.out.blank(line)
        elif start.startswith("#+") and start[:6].upper() == "#+END_":
            self._text(line, bare)
        elif start.startswith(("#", "|", "file:", "http://", "https://")):
            self.out.keep(line)
        else:
            self._text(line, bare)

    def _text(self, line: str, bare: str) -> None:
        if m := self.headline.fullmatch(line):
            self.out.titled(m[1], m[2])
        elif m := self.item.fullmatch(line):
            self.depth = len(m[1].encode())
            self.out.titled(m[1], m[2])
        elif self.depth is not None and indent(line) >= self.depth and self.out.regions and self.out.regions[-1] == (STRUCTURE, "\n"):
            close = self.out.regions.pop()
            if self.out.regions and self.out.regions[-1][0] == PROSE:
                self.out.regions[-1] = (PROSE, f"{self.out.regions[-1][1]} {bare}")
            else:
                self.out.regions.append((PROSE, bare))
            self.out.regions.append(close)
        else:
            self.depth = None
            self.prose(bare)


class Latex(Syntax):
    kept = frozenset(KEPT_ENVIRONMENTS)
    begin = re.compile(r"\\begin\{(\w+\*?)\}")
    end = re.compile(r"\\end\{(\w+\*?)\}")
    opens = re.compile(r"\s*\\\[")
    closes = re.compile(r"\\\]\s*\Z")

    def __init__(self, lines: list[str]) -> None:
        super().__init__(lines)
        self.span = lambda x: "\\begin{document}" in x  # the preamble

    def line(self, i: int, line: str, bare: str) -> None:
        m = self.begin.search(line)
        if not bare:
            self.out.blank(line)
        elif bare.startswith("%") or "\\end{document}" in line:
            self.out.keep(line)
        elif m and m[1] in self.kept:
            name = m[1]
            ends = lambda x: (e := self.end.search(x)) is not None and e[1] == name
            self.out.keep(line) if ends(line) else self.until(line, ends)
        elif self.opens.match(line):
            self.out.keep(line) if self.closes.search(line) else self.until(line, lambda x: bool(self.closes.search(x)))
        else:
            self.prose(bare)


class Rst(Syntax):
    underline = re.compile(r"([=\-~^\"#*+])\1+")
    field = re.compile(r":[^:]+:.+")

    def within(self, depth: int) -> Callable[[str], bool | None]:
        """Blank lines and lines at least so deep."""
        return lambda x: False if not x.strip(WHITE) or indent(x) >= depth else None

    def line(self, i: int, line: str, bare: str) -> None:
        start = line.lstrip(WHITE)
        following = self.lines[i + 1] if i + 1 < len(self.lines) else ""
        if not bare:
            self.out.blank(line)
        elif start.startswith(".. "):
            self.out.keep(line)
            if "::" in start:
                self.span = self.within(indent(line) + 3)
        elif self.underline.fullmatch(bare) or self.underline.fullmatch(following.strip(WHITE)):
            self.out.keep(line)
        elif self.field.fullmatch(start):
            self.out.keep(line)
        elif start.endswith("::"):
            self.out.keep(line)
            depth = next((indent(x) for x in self.lines[i + 1 :] if x.strip(WHITE)), 0)
            if depth:
                self.span = self.within(depth)
        elif start.startswith(("|", "+")):
            self.out.keep(line)
        else:
            self.prose(start)


SYNTAXES: dict[str, type[Syntax]] = {"plaintext": Syntax, "markdown": Markdown, "org": Org, "latex": Latex, "rst": Rst}


def regions_of(text: str, format: str | None, marker: str = MARKER) -> list[Region]:
    """Regions of a text whose lines end in LF; an unknown format is plain text."""
    return SYNTAXES.get(format or "plaintext", Syntax)(lines_of(text)).read(marker)

"""Rich text to paragraphs: a tokenizer and a stack of groups.

A group keeps whether its text is hidden (it is a table, a picture, a header or the like), and how many characters stand in for a Unicode one (\\uc). A control
word acts on the group that it stands in, and what it changed ends with the group.
"""

from __future__ import annotations

import re

# Groups that hold no text of the document.
HIDDEN = frozenset(
    "fonttbl colortbl stylesheet listtable listoverridetable rsidtbl generator info pict object themedata colorschememapping datastore latentstyles xmlnstbl fldinst header headerl headerr headerf footer footerl footerr footerf ftnsep".split()
)
# What control words and symbols stand for, and the code page of each character set.
TEXT_OF = {"par": "\n", "line": "\n", "page": "\n", "column": "\n", "sect": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "\u2014", "endash": "\u2013", "bullet": "\u2022", "lquote": "\u2018", "rquote": "\u2019", "ldblquote": "\u201c", "rdblquote": "\u201d", "~": " ", "_": "-", "-": "", "\n": "\n", "\r": "\n", "{": "{", "}": "}", "\\": "\\"}
CODE_PAGES = {"ansi": "cp1252", "mac": "mac_roman", "pc": "cp437", "pca": "cp850"}

TOKEN = re.compile(r"(?P<open>\{)|(?P<close>\})|\\'(?P<byte>[0-9a-fA-F]{2})|\\(?P<word>[a-zA-Z]+)(?P<number>-?\d+)? ?|\\(?P<sign>[^a-zA-Z])|(?P<text>[^\\{}\r\n]+)|(?P<blank>[\r\n]+)|(?P<stray>\\)", re.DOTALL)


class _Reader:
    def __init__(self):
        self.page, self.out, self.stack = "cp1252", [], []
        self.hidden, self.stand_in, self.skip, self.starred = False, 1, 0, False
        self.raw, self.high = bytearray(), None

    def put(self, text: str) -> None:
        """Text of the document, less what stands in for a Unicode character before it."""
        if self.raw:
            raw, self.raw = bytes(self.raw), bytearray()
            self.out.append(raw.decode(self.page, "replace"))
        left = text[self.skip :]
        self.skip = max(0, self.skip - len(text))
        if left and not self.hidden:
            self.out.append(left)

    def unicode(self, code: int) -> None:
        code %= 65536
        self.skip = 0
        if 0xD800 <= code < 0xDC00:
            self.high = code
        elif 0xDC00 <= code < 0xE000:
            if self.high is not None:
                self.put(chr(0x10000 + ((self.high - 0xD800) << 10) + code - 0xDC00))
            self.high = None
        else:
            self.put(chr(code))
        self.skip = self.stand_in

    def byte(self, value: str) -> None:
        if self.skip:
            self.skip -= 1
        elif not self.hidden:
            self.raw += bytes.fromhex(value)  # kept, as a character may have two

    def word(self, word: str, number: str | None) -> None:
        if word == "u" and number:
            self.unicode(int(number))
        elif word == "uc":
            self.stand_in = int(number or 1)
        elif word == "ansicpg":
            self.page = f"cp{number}" if number and _known(f"cp{number}") else "cp1252"
        elif word in CODE_PAGES:
            self.page = CODE_PAGES[word]
        elif word in HIDDEN or self.starred:
            self.hidden = True
        elif word in TEXT_OF:
            self.skip = 0
            self.put(TEXT_OF[word])
        self.starred = False

    def sign(self, sign: str) -> None:
        if sign == "*":
            self.starred = True
        elif sign in TEXT_OF:
            self.put(TEXT_OF[sign])


def _known(page: str) -> bool:
    try:
        "".encode(page)
    except LookupError:
        return False
    return True


def rtf_text(rtf: str) -> str:
    r = _Reader()
    at = 0
    while m := TOKEN.match(rtf, at):
        at = m.end()
        kind = m.lastgroup
        if kind != "byte" and r.raw:
            r.put("")
        if kind == "open":
            r.stack.append((r.hidden, r.stand_in, r.page))
            r.skip, r.starred = 0, False
        elif kind == "close":
            r.skip, r.starred = 0, False
            if r.stack:
                r.hidden, r.stand_in, r.page = r.stack.pop()
        elif kind == "byte":
            r.byte(m["byte"])
        elif m["word"]:
            if m["word"] == "bin" and m["number"]:
                at += max(0, int(m["number"]))  # so many characters are no rich text
            r.word(m["word"], m["number"])
        elif kind == "sign":
            r.sign(m["sign"])
        elif kind == "text":
            r.put(m["text"])
    r.put("")
    return "".join(r.out)


def parse_rtf(rtf: str) -> list[tuple[str, int | None, str]]:
    """Paragraphs of a rich text: what stands between breaks of paragraph, line, page, column, section or row, without blanks at its ends."""
    lines = (re.sub(r"[ \t]+", " ", p).strip() for p in rtf_text(rtf).split("\n"))
    return [("PARAGRAPH", None, p) for p in lines if p]

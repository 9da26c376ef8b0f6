"""Character classes, patterns and decoding that blocks and inlines share. Everything works on bytes."""

from __future__ import annotations

import html.entities
import re

SPACES = b" \t\n\r"
ASCII_PUNCTUATION = frozenset(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")

# The code points that count as white space and (beyond ASCII) as punctuation when delimiter runs are
# classified; inclusive ranges in hexadecimal.
UNICODE_SPACES = frozenset([9, 10, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000])
PUNCTUATION_RANGES = """
a1 a7 ab b6-b7 bb bf 37e 387 55a-55f 589-58a 5be 5c0 5c3 5c6 5f3-5f4 609-60a 60c-60d 61b 61e-61f 66a-66d 6d4 700-70d
7f7-7f9 830-83e 85e 964-965 970 af0 df4 e4f e5a-e5b f04-f12 f14 f3a-f3d f85 fd0-fd4 fd9-fda 104a-104f 10fb 1360-1368
1400 166d-166e 169b-169c 16eb-16ed 1735-1736 17d4-17d6 17d8-17da 1800-180a 1944-1945 1a1e-1a1f 1aa0-1aa6 1aa8-1aad
1b5a-1b60 1bfc-1bff 1c3b-1c3f 1c7e-1c7f 1cc0-1cc7 1cd3 2010-2027 2030-2043 2045-2051 2053-205e 207d-207e 208d-208e
2308-230b 2329-232a 2768-2775 27c5-27c6 27e6-27ef 2983-2998 29d8-29db 29fc-29fd 2cf9-2cfc 2cfe-2cff 2d70 2e00-2e2e
2e30-2e42 3001-3003 3008-3011 3014-301f 3030 303d 30a0 30fb a4fe-a4ff a60d-a60f a673 a67e a6f2-a6f7 a874-a877 a8ce-a8cf
a8f8-a8fa a92e-a92f a95f a9c1-a9cd a9de-a9df aa5c-aa5f aade-aadf aaf0-aaf1 abeb fd3e-fd3f fe10-fe19 fe30-fe52 fe54-fe61
fe63 fe68 fe6a-fe6b ff01-ff03 ff05-ff0a ff0c-ff0f ff1a-ff1b ff1f-ff20 ff3b-ff3d ff3f ff5b ff5d ff5f-ff65 10100-10102
1039f 103d0 1056f 10857 1091f 1093f 10a50-10a58 10a7f 10af0-10af6 10b39-10b3f 10b99-10b9c 11047-1104d 110bb-110bc
110be-110c1 11140-11143 11174-11175 111c5-111c8 111cd 11238-1123d 114c6 115c1-115c9 11641-11643 12470-12474 16a6e-16a6f
16af5 16b37-16b3b 16b44 1bc9f
"""


def _points(ranges: str) -> frozenset[int]:
    out: set[int] = set()
    for part in ranges.split():
        low, _, high = part.partition("-")
        out.update(range(int(low, 16), int(high or low, 16) + 1))
    return frozenset(out)


PUNCTUATION = ASCII_PUNCTUATION | _points(PUNCTUATION_RANGES)

MAX_LABEL = 1000

# -- Fixed values: patterns of lines and inlines; those of lines are matched at the first character that is not a space -----
_ESCAPED = rb"\\[!-/:-@\[-`{-~]"
_SP = rb"[ \t\v\f\r\n]"
_ATTRIBUTE = rb"(?:" + _SP + rb"+[a-zA-Z_:][a-zA-Z0-9:._-]*(?:" + _SP + rb"*=" + _SP + rb"*(?:[^ \t\r\n\v\f\"'=<>`\0]+|'[^'\0]*'|\"[^\"\0]*\"))?)"
_OPEN_TAG = rb"[A-Za-z][A-Za-z0-9-]*" + _ATTRIBUTE + rb"*" + _SP + rb"*/?>"
_CLOSE_TAG = rb"/[A-Za-z][A-Za-z0-9-]*" + _SP + rb"*>"
HTML_TAG = re.compile(rb"(?:" + _OPEN_TAG + rb"|" + _CLOSE_TAG + rb")")

ATX = re.compile(rb"#{1,6}(?:[ \t]+|[\r\n])")
SETEXT = re.compile(rb"(=+|-+)[ \t]*[\r\n]")
RULE = re.compile(rb"([*_-])(?:[ \t]*\1){2,}[ \t]*[\r\n]")
FENCE = re.compile(rb"(`{3,})(?=[^`\r\n\0]*[\r\n])|(~{3,})(?=[^\r\n\0]*[\r\n])")
FENCE_END = re.compile(rb"(`{3,}|~{3,})(?=[ \t]*[\r\n])")
NOTE_OPEN = re.compile(rb"\[\^([^\] \r\n\0\t]+)\]:[ \t]*")
TASK = re.compile(rb"\[([ xX])\][ \t\v\f]+")
TABLE_START = re.compile(rb"\|?[ \t\v\f]*:?-+:?[ \t\v\f]*(?:\|[ \t\v\f]*:?-+:?[ \t\v\f]*)*\|?[ \t\v\f]*\r?\n")
CELL = re.compile(rb"(?:[^|\r\n\0\\]|\\\|?)+")
CELL_END = re.compile(rb"\|[ \t\v\f]*")
ROW_END = re.compile(rb"[ \t\v\f]*\r?\n")
BLANK_REST = re.compile(rb"[ \t]*(?:[\r\n]|\Z)")

# Fixed value: names of elements that begin an HTML block of the sixth kind.
BLOCK_TAGS = (
    b"address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset "
    b"figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem "
    b"nav noframes ol optgroup option p param section source summary table tbody td tfoot th thead title tr track ul"
).split()
HTML_STARTS = (
    (1, re.compile(rb"<(?:script|pre|textarea|style)(?:" + _SP + rb"|>)", re.I)),
    (2, re.compile(rb"<!--")),
    (3, re.compile(rb"<\?")),
    (4, re.compile(rb"<![A-Z]")),
    (5, re.compile(rb"<!\[CDATA\[", re.I)),
    (6, re.compile(rb"</?(?:" + rb"|".join(sorted(BLOCK_TAGS, key=len, reverse=True)) + rb")(?:" + _SP + rb"|/?>)", re.I)),
)
HTML_START_7 = re.compile(rb"<(?:" + _OPEN_TAG + rb"|" + _CLOSE_TAG + rb")[\t\n\f ]*[\r\n]")
HTML_ENDS = {
    1: re.compile(rb"[^\n\0]*</(?:script|pre|textarea|style)>", re.I),
    2: re.compile(rb"[^\n\0]*-->"),
    3: re.compile(rb"[^\n\0]*\?>"),
    4: re.compile(rb"[^\n\0]*>"),
    5: re.compile(rb"[^\n\0]*\]\]>"),
}

# -- patterns of inlines --------------------------------------------------------------------------------------------------
AUTOLINK_URI = re.compile(rb"[A-Za-z][A-Za-z0-9.+-]{1,31}:[^\0- <>]*>")
AUTOLINK_EMAIL = re.compile(
    rb"[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*>"
)
DECLARATION = re.compile(rb"[A-Z]+" + _SP + rb"+[^>\0]*")
SPACE_RUN = re.compile(_SP + rb"*")
TITLE = re.compile(rb"\"(?:" + _ESCAPED + rb"|[^\"\0])*\"|'(?:" + _ESCAPED + rb"|[^'\0])*'|\((?:" + _ESCAPED + rb"|[^()\0])*\)")
DIRECTIVE_NAME = re.compile(rb"[A-Za-z0-9_-]+")

_ENTITY = re.compile(rb"#([0-9]+);|#[xX]([0-9a-fA-F]+);|([A-Za-z][A-Za-z0-9]*);")
_NAMED = {name[:-1].encode(): value.encode() for name, value in html.entities.html5.items() if name.endswith(";")}


def entity(data: bytes, at: int) -> tuple[bytes, int] | None:
    """What the character reference behind the `&` before `at` stands for, and where it ends."""
    found = _ENTITY.match(data, at)
    if not found:
        return None
    decimal, hexadecimal, name = found.groups()
    if name is not None:
        value = _NAMED.get(name)
        return (value, found.end()) if value is not None else None
    digits = decimal or hexadecimal
    if len(digits) > 8:
        return None
    code = int(digits, 10 if decimal else 16)
    if code == 0 or 0xD800 <= code < 0xE000 or code >= 0x110000:
        code = 0xFFFD
    return chr(code).encode(), found.end()


def decode_entities(data: bytes) -> bytes:
    if b"&" not in data:
        return data
    out, at = [], 0
    while (found := data.find(b"&", at)) >= 0:
        out.append(data[at:found])
        known = entity(data, found + 1)
        if known:
            out.append(known[0])
            at = known[1]
        else:
            out.append(b"&")
            at = found + 1
    out.append(data[at:])
    return b"".join(out)


_BACKSLASHED = re.compile(rb"\\([!-/:-@\[-`{-~])")


def unescape(data: bytes) -> bytes:
    return _BACKSLASHED.sub(rb"\1", data) if b"\\" in data else data


def clean_url(data: bytes) -> bytes:
    return unescape(decode_entities(data.strip(SPACES)))


def clean_title(data: bytes) -> bytes | None:
    """None for no title; the empty title is a title."""
    if not data:
        return None
    if (data[:1], data[-1:]) in ((b"'", b"'"), (b"(", b")"), (b'"', b'"')):
        data = data[1:-1]
    return unescape(decode_entities(data))


_RUNS = re.compile(rb"[ \t\n\r]+")


def fold_label(label: bytes) -> bytes | None:
    """The form in which labels are compared; None for a label that names nothing."""
    if not 0 < len(label) <= MAX_LABEL:
        return None
    folded = label.lower() if label.isascii() else label.decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape")
    return _RUNS.sub(b" ", folded.strip(SPACES)) or None


_WIDTHS = [1] * 0x80 + [0] * 0x42 + [2] * 0x1E + [3] * 0x10 + [4] * 5 + [0] * 11


def code_point(data: bytes, at: int) -> tuple[int, int]:
    """The code point at a byte offset and its width; (-1, 0) where none begins."""
    first = data[at]
    if first < 0x80:
        return first, 1
    width = _WIDTHS[first]
    if not width or at + width > len(data):
        return -1, 0
    try:
        return ord(data[at : at + width].decode()), width
    except (UnicodeDecodeError, TypeError):
        return -1, 0


def code_point_before(data: bytes, at: int, transparent: frozenset[int] = frozenset()) -> int:
    """The code point that ends before `at`, over transparent bytes; a line end at the start of the text."""
    if at == 0:
        return 10
    k = at - 1
    while k > 0 and (data[k] >> 6 == 2 or data[k] in transparent):
        k -= 1
    code, width = code_point(data, k)
    return 10 if not width or (code < 256 and code in transparent) else code


def code_point_after(data: bytes, at: int, transparent: frozenset[int] = frozenset()) -> int:
    while at < len(data) and data[at] in transparent:
        at += 1
    if at >= len(data):
        return 10
    code, width = code_point(data, at)
    return code if width else 10


def is_comment(literal: bytes) -> bool:
    """Whether an HTML literal is one complete comment."""
    body = literal.rstrip(b"\n \t").lstrip(b" ")
    if not body.startswith(b"<!--"):
        return False
    close = body.find(b"-->", 1)
    return close >= 0 and close + 3 == len(body)

"""The lexical tests of the grammar as Catalyst expressions over a string column, for questions that need no tree.

Each takes a line (or the text from some point on) without its line end and says whether, or what, it begins with.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SP = r"[ \t\x0B\f\r\n]"
_ATTRIBUTE = rf"(?:{_SP}+[a-zA-Z_:][a-zA-Z0-9:._-]*(?:{_SP}*={_SP}*(?:[^ \t\r\n\x0B\f\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)"
_TAG = rf"(?:[A-Za-z][A-Za-z0-9-]*{_ATTRIBUTE}*{_SP}*/?>|/[A-Za-z][A-Za-z0-9-]*{_SP}*>)"

#: Patterns by name, without anchors; group 1, where there is one, is what `extract` gives.
PATTERNS = {
    "atx_heading_start": r"(#{1,6})(?:[ \t]|$)",
    "setext_heading_line": r"(=+|-+)[ \t]*$",
    "thematic_break": r"(?:\*[ \t]*(?:\*[ \t]*){2,}|-[ \t]*(?:-[ \t]*){2,}|_[ \t]*(?:_[ \t]*){2,})$",
    "list_marker": r"([*+-]|[0-9]{1,9}[.)])(?:[ \t]|$)",
    "open_code_fence": r"(`{3,})[^`]*$|(~{3,}).*$",
    "close_code_fence": r"(`{3,}|~{3,})[ \t]*$",
    "footnote_definition": r"\[\^([^\] \r\n\t]+)\]:",
    "table_start": r"\|?[ \t\x0B\f]*:?-+:?[ \t\x0B\f]*(?:\|[ \t\x0B\f]*:?-+:?[ \t\x0B\f]*)*\|?[ \t\x0B\f]*$",
    "tasklist": r"\[([ xX])\][ \t\x0B\f]",
    "autolink_uri": r"([A-Za-z][A-Za-z0-9.+-]{1,31}:[^\x00- <>]*)>",
    "autolink_email": r"([a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*)>",
    "html_tag": rf"({_TAG})",
    "html_comment": r"(--(?:>|->|.*?-->))",
    "html_pi": r"(.*?\?>)",
    "html_declaration": rf"([A-Z]+{_SP}+[^>]*)",
    "html_cdata": r"(CDATA\[.*?\]\]>)",
    "html_block_start_7": rf"<({_TAG})[\t\n\f ]*$",
    "link_title": r"""("(?:\\[!-/:-@\[-`{-~]|[^"])*"|'(?:\\[!-/:-@\[-`{-~]|[^'])*'|\((?:\\[!-/:-@\[-`{-~]|[^()])*\))""",
    "spacechars": rf"({_SP}+)",
    "table_cell": r"((?:[^|\r\n\\]|\\\|?)+)",
    "table_cell_end": r"(\|[ \t\x0B\f]*)",
    "table_row_end": r"([ \t\x0B\f]*)$",
    "formula_dollar_inline_open": r"(\$)",
    "formula_dollar_display_open": r"(\$\$)",
    "formula_latex_backslash_inline_open": r"(\\\\\()",
    "formula_latex_backslash_display_open": r"(\\\\\[)",
    "directive_name": r"([A-Za-z0-9_-]+)",
}
#: Ends of HTML blocks of the first five kinds, anywhere in the line.
HTML_BLOCK_ENDS = {1: r"(?i)</(?:script|pre|textarea|style)>", 2: r"-->", 3: r"\?>", 4: r">", 5: r"\]\]>"}


def matches(scanner: str, text: Column) -> Column:
    return text.rlike(rf"\A(?:{PATTERNS[scanner]})")


def extract(scanner: str, text: Column) -> Column:
    """What the scanner's group holds; null if the text doesn't begin so."""
    return F.when(matches(scanner, text), F.regexp_extract(text, rf"\A(?:{PATTERNS[scanner]})", 1))


def html_block_end(kind: int, line: Column) -> Column:
    return line.rlike(HTML_BLOCK_ENDS[kind])


def html_block_start(line: Column) -> Column:
    """Kind of the HTML block that a line begins, 1 to 6; null if none."""
    from inkstrata.core.lexis import BLOCK_TAGS

    tags = "|".join(sorted((t.decode() for t in BLOCK_TAGS), key=len, reverse=True))
    return (
        F.when(line.rlike(rf"(?i)\A<(?:script|pre|textarea|style)(?:{_SP}|>|\z)"), 1)
        .when(line.rlike(r"\A<!--"), 2)
        .when(line.rlike(r"\A<\?"), 3)
        .when(line.rlike(r"\A<![A-Z]"), 4)
        .when(line.rlike(r"(?i)\A<!\[CDATA\["), 5)
        .when(line.rlike(rf"(?i)\A</?(?:{tags})(?:{_SP}|/?>|\z)"), 6)
    )


def lines(text: Column) -> Column:
    """The lines of a text, by LF, CR or CRLF; a final line end begins no line."""
    split = F.split(text, "\r\n|\r|\n")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.when(text.rlike(r"[\r\n]\z"), F.slice(split, 1, F.size(split) - 1)).otherwise(split))


def is_blank(line: Column) -> Column:
    return line.rlike(r"\A[ \t]*\z")


def indent(line: Column) -> Column:
    """Columns of leading space, tabs to stops of four."""
    spaces = F.regexp_extract(line, r"\A[ \t]*", 0)
    cells = F.split(spaces, "")
    return F.aggregate(cells, F.lit(0), lambda n, c: F.when(c == "\t", n + 4 - n % 4).when(c == " ", n + 1).otherwise(n))

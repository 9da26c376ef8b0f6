"""The block structure of a document, line by line."""

from __future__ import annotations

import re
from functools import lru_cache

from inkstrata.core import attributes as attrs
from inkstrata.core import lexis as lx
from inkstrata.core.inlines import link_destination, link_label
from inkstrata.core.tree import Block, Node

CODE_INDENT, TAB, MAX_DEPTH = 4, 4, 100
MAX_FILLED_CELLS, MAX_CELLS, MAX_FENCE = 0x80000, 0xFFFF, 255

BLOCKS = frozenset(
    "BlockQuote List CodeBlock HTMLBlock Paragraph Heading ThematicBreak FootnoteDefinition ReferenceDefinition FormulaBlock Table DirectiveBlock".split()
)
ANY = frozenset(("Document", "BlockQuote", "FootnoteDefinition", "ListItem", "DirectiveBlock"))
ONLY = {"List": "ListItem", "Table": "TableRow", "TableRow": "TableCell"}
LEAVES_WITH_LINES = frozenset(("Paragraph", "Heading", "CodeBlock"))
#: How an open block takes a line: it goes on, does not match, or ends with this line.
GOES_ON, NO, ENDS = 1, 0, -1


def holds(parent: Block, kind: str) -> bool:
    return kind in BLOCKS if parent.kind in ANY else ONLY.get(parent.kind) == kind


class Machine:
    """Takes lines and grows the tree. `definitions` and `notes` gather labels in the order they are defined."""

    def __init__(self, options):
        self.options = options
        self.root = self.tip = Block("Document", 1, 1)
        self.number = self.last_length = 0
        self.text, self.in_line = b"", False
        self.row: tuple[int, tuple | None] = (-1, None)  # where a table's row was scanned in this line, and what was found
        self.offset = self.column = self.start = self.start_column = self.indent = 0
        self.blank = self.split_tab = False
        self.marks: list[tuple[int, int, int, int]] = []  # of the open paragraph: content offset, line, byte, spaces for a tab
        self.links: set[bytes] = set()
        self.notes: set[bytes] = set()
        self.diagnostics: list[tuple[int, int, int, int]] = []
        self.openers, self.openers_by_byte = _openers(options)

    # -- the cursor in a line -----------------------------------------------------------------------------------------

    def look(self) -> None:
        """Find the first character that is no space or tab, its column, the indent, and whether the rest is blank."""
        text, at, column = self.text, self.offset, self.column
        c = text[at] if at < len(text) else 0
        if c != 0x20 and c != 0x09:
            self.start, self.start_column, self.indent = at, column, 0
            self.blank = c == 0x0A or c == 0x0D
            return
        while True:
            c = text[at] if at < len(text) else 0
            if c == 0x20:
                column += 1
            elif c == 0x09:
                column += TAB - column % TAB
            else:
                break
            at += 1
        self.start, self.start_column, self.indent = at, column, column - self.column
        self.blank = c in (0x0A, 0x0D)

    def advance(self, n: int, columns: bool = False) -> None:
        text = self.text
        if n > 0 and text.find(b"\t", self.offset, self.offset + n) < 0:
            n = min(n, len(text) - self.offset)
            if n > 0:
                self.split_tab = False
                self.offset += n
                self.column += n
            return
        while n > 0 and self.offset < len(text):
            if text[self.offset] != 0x09:
                self.split_tab = False
                self.offset += 1
                self.column += 1
                n -= 1
                continue
            width = TAB - self.column % TAB
            if columns:
                self.split_tab = width > n
                step = min(n, width)
                self.column += step
                self.offset += not self.split_tab
                n -= step
            else:
                self.split_tab = False
                self.column += width
                self.offset += 1
                n -= 1

    def skip_space(self) -> None:
        if self.offset < len(self.text) and self.text[self.offset] in b" \t":
            self.advance(1, True)

    def at(self, k: int) -> int:
        return self.text[k] if k < len(self.text) else 0

    # -- lines ---------------------------------------------------------------------------------------------------------

    def feed(self, line: bytes) -> None:
        self.text = line if line.endswith((b"\n", b"\r")) else line + b"\n"
        self.in_line = True
        self.offset = self.column = self.start = self.start_column = self.indent = 0
        self.blank = self.split_tab = False
        self.row = (-1, None)
        if self.number == 0 and self.text.startswith(b"\xef\xbb\xbf"):
            self.offset = 3
        self.number += 1
        matched, whole = self.match()
        if matched is not None:
            container = self.open(matched, whole)
            self.place(container, matched)
        self.last_length = self.length()
        self.in_line = False

    def length(self) -> int:
        text, n = self.text, len(self.text)
        if n and text[n - 1] == 0x0A:
            n -= 1
        return n - 1 if n and text[n - 1] == 0x0D else n

    def finish(self) -> Block:
        while self.tip is not None:
            self.tip = self.close(self.tip)
        return self.root

    def match(self) -> tuple[Block | None, bool]:
        """The deepest open block that this line goes on with; None if the line ended a block."""
        block = self.root
        while isinstance(block.last, Block) and block.last.is_open:
            child = block.last
            self.look()
            kind = child.kind
            if kind == "Paragraph":
                result = NO if self.blank else GOES_ON
            else:
                matcher = _MATCHERS.get(kind)
                result = matcher(self, child) if matcher else GOES_ON
            if result == ENDS:
                return None, False
            if result == NO:
                return block, False
            block = child
        return block, True

    def place(self, block: Block, matched: Block) -> None:
        """Add what is left of the line to a block, or to the open paragraph that it lazily goes on with."""
        self.look()
        blank = self.blank
        if blank and isinstance(block.last, Block):
            block.last.last_blank = True
        takes_lines = self.takes_lines(block)
        block.last_blank = (
            blank
            and block.kind not in ("BlockQuote", "Heading", "ThematicBreak")
            and not takes_lines
            and not (block.kind == "CodeBlock" and block.state["fenced"])
            and not (block.kind == "ListItem" and block.first is None and block.line == self.number)
        )
        above = block.parent
        while above is not None:
            above.last_blank = False
            above = above.parent
        if self.tip is not matched and block is matched and not blank and self.tip.kind == "Paragraph":
            self.add_line(self.tip)
            return
        while self.tip is not matched:
            self.tip = self.close(self.tip)
        if block.kind == "CodeBlock":
            if not (block.state["fenced"] and block.line == self.number):
                self.add_line(block)
        elif block.kind == "HTMLBlock":
            self.add_line(block)
            end = lx.HTML_ENDS.get(block.state["type"])
            if end is not None and end.match(self.text, self.start):
                block = self.close(block)
        elif takes_lines:
            self.add_line(block)
        elif blank:
            pass
        else:
            if block.kind == "Heading":
                self.text = _without_closing_hashes(self.text)
            elif block.kind != "Paragraph":
                block = self.add(block, "Paragraph", self.start + 1)
                self.marks = []
            self.advance(self.start - self.offset)
            self.add_line(block)
        self.tip = block

    def add_line(self, block: Block) -> None:
        fresh, content = not block.content, block.content
        begin = len(content)
        if block.kind == "Paragraph":
            self.marks.append((begin, self.number, self.offset, TAB - self.column % TAB if self.split_tab else 0))
        if self.split_tab:
            self.offset += 1
            content += b" " * (TAB - self.column % TAB)
        content += self.text[self.offset :]
        if block.kind == "Paragraph" and not fresh and content[begin : begin + 1] == b"[":
            self.harvest(block, True)

    @staticmethod
    def takes_lines(block: Block) -> bool:
        """Whether a block of an extension swallows the line."""
        if block.kind == "DirectiveBlock":
            return block.state["fence"] == 2 or block.state["swallow"]
        return block.kind == "FormulaBlock"

    # -- tree ----------------------------------------------------------------------------------------------------------

    def add(self, parent: Block, kind: str, column: int) -> Block:
        while not holds(parent, kind):
            parent = self.close(parent)
        return parent.append(Block(kind, self.number, column))

    def close(self, block: Block) -> Block | None:
        """Close a block: its end, and what its kind settles at the end. Returns its parent."""
        parent, block.is_open = block.parent, False
        with_line = self.in_line and ("ends_here" in block.state or _ends_with_line(block))
        block.eline = self.number - (self.in_line and not with_line)
        block.ecol = self.length() if with_line else self.last_length
        settle = _SETTLERS.get(block.kind)
        if settle is not None:
            settle(self, block)
        return parent

    def settle_paragraph(self, block: Block) -> None:
        if not self.harvest(block, False):
            block.detach()

    def settle_code(self, block: Block) -> None:
        literal = bytes(block.content)
        block.fields["literal"] = literal if block.state["fenced"] else _without_blank_tail(literal) + b"\n"

    def settle_html(self, block: Block) -> None:
        block.fields["literal"] = bytes(block.content)

    def settle_list(self, block: Block) -> None:
        block.fields["tight"] = not _is_loose(block)

    # -- definitions ---------------------------------------------------------------------------------------------------

    def source(self, block: Block, at: int, cursor: int) -> tuple[int, int, int]:
        """Line and column that byte `at` of a paragraph's content came from, and the mark it was found by."""
        marks = self.marks
        while cursor + 1 < len(marks) and marks[cursor + 1][0] <= at:
            cursor += 1
        if not marks or marks[cursor][0] > at:
            return block.line, block.col, cursor
        begin, line, byte, pad = marks[cursor]
        return line, _byte_column(begin, byte, pad, at) + 1, cursor

    def harvest(self, block: Block, settled: bool) -> bool:
        """Take the definitions at the front of a paragraph; whether anything but space is left.

        With `settled` only those that no later line can change: another bracket follows them.
        """
        if block.content[:1] != b"[":
            return bool(block.content.strip(b" \t\n\r"))
        content, at, cursor = bytes(block.content), 0, 0
        while content[at : at + 1] == b"[":
            found = definition(content, at)
            if found is None:
                break
            label, url, title, end = found
            if settled and content[end : end + 1] != b"[":
                break
            last = len(content[at:end].rstrip(b" \t\n\r")) + at
            node = Node("ReferenceDefinition", label=_raw_label(content[at:last]), destination=None, title=None)
            key = lx.fold_label(label) if label else None
            if key is not None:
                self.links.add(key)
                node.fields["destination"], node.fields["title"] = lx.clean_url(url), lx.clean_title(title)
            node.line, node.col, cursor = self.source(block, at, cursor)
            node.eline, node.ecol, cursor = self.source(block, max(at, last - 1), cursor)
            block.put_before(node)
            at = end
        if at:
            block.line, block.col, cursor = self.source(block, at, cursor)
            del block.content[:at]
            if settled:
                self.marks = [(begin - at, line, byte, pad) for begin, line, byte, pad in self.marks if begin >= at]
        return bool(block.content.strip(b" \t\n\r"))

    # -- open blocks meeting a line ------------------------------------------------------------------------------------

    def on_quote(self, block: Block) -> int:
        if self.indent > 3 or self.at(self.start) != 0x3E:
            return NO
        self.advance(self.indent + 1, True)
        self.skip_space()
        return GOES_ON

    def on_item(self, block: Block) -> int:
        width = block.state["margin"] + block.state["padding"]
        if self.indent >= width:
            self.advance(width, True)
        elif self.blank and block.first is not None:
            self.advance(self.start - self.offset)
        else:
            return NO
        return GOES_ON

    def on_note(self, block: Block) -> int:
        if self.indent >= CODE_INDENT:
            self.advance(CODE_INDENT, True)
            return GOES_ON
        return GOES_ON if self.text.startswith((b"\n", b"\r\n")) else NO

    def on_code(self, block: Block) -> int:
        state = block.state
        if not state["fenced"]:
            if self.indent >= CODE_INDENT:
                self.advance(CODE_INDENT, True)
            elif self.blank:
                self.advance(self.start - self.offset)
            else:
                return NO
            return GOES_ON
        found = lx.FENCE_END.match(self.text, self.start) if self.indent <= 3 and self.at(self.start) == state["char"] else None
        if found and len(found[1]) >= state["size"]:
            block.fields["closed"] = True
            self.advance(len(found[1]))
            self.tip = self.close(block)
            return ENDS
        for _ in range(state["margin"]):
            self.skip_space()
        return GOES_ON

    def on_html(self, block: Block) -> int:
        return NO if self.blank and block.state["type"] >= 6 else GOES_ON

    def on_table(self, block: Block) -> int:
        self.row = self.start, scan_row(self.text[self.start :])
        return GOES_ON if self.row[1] is not None else NO

    def on_formula(self, block: Block) -> int:
        if block.state["done"]:
            return NO
        mark = block.state["mark"]
        if self.text.startswith(mark, self.start) and lx.BLANK_REST.match(self.text, self.start + len(mark)):
            block.state["done"] = True
            self.advance(len(self.text) - self.offset)
        return GOES_ON

    def on_directive(self, block: Block) -> int:
        state = block.state
        if state["done"]:
            return NO
        state["swallow"] = False
        colons = _run(self.text, self.start, 0x3A)
        if self.indent <= 3 and colons >= state["fence"] and lx.BLANK_REST.match(self.text, self.start + colons):
            state["done"] = state["swallow"] = True
            self.advance(len(self.text) - self.offset)
            while self.tip is not block:
                self.tip = self.close(self.tip)
            state["ends_here"] = True
            self.tip = self.close(block)
            return ENDS
        return GOES_ON

    # -- new blocks ----------------------------------------------------------------------------------------------------

    def open(self, block: Block, whole: bool) -> Block:
        """Open what the line starts, in order of precedence, until a block that takes lines."""
        lazy, depth = self.tip.kind == "Paragraph", 0
        while block.kind not in ("CodeBlock", "HTMLBlock") and not self.takes_lines(block):
            depth += 1
            self.look()
            self.whole, self.lazy, self.depth, self.deep = whole, lazy, depth, self.indent >= CODE_INDENT
            opened = None
            openers = self.openers if self.deep or block.kind == "Table" else self.openers_by_byte[self.at(self.start)]
            for opener in openers:
                opened = opener(self, block)
                if opened is not None:
                    break
            if opened is None:
                break
            block = opened
            if block.kind in LEAVES_WITH_LINES or self.takes_lines(block):
                break
            lazy = False
        return block

    def quote(self, block: Block) -> Block | None:
        if self.deep or self.at(self.start) != 0x3E:
            return None
        start = self.start
        self.advance(start + 1 - self.offset)
        self.skip_space()
        return self.add(block, "BlockQuote", start + 1)

    def atx(self, block: Block) -> Block | None:
        found = None if self.deep else lx.ATX.match(self.text, self.start)
        if not found:
            return None
        self.advance(found.end() - self.offset)
        heading = self.add(block, "Heading", self.start + 1)
        heading.fields["level"] = _run(self.text, self.start, 0x23)
        heading.inline_offset = found.end() - found.start()
        return heading

    def fence(self, block: Block) -> Block | None:
        found = None if self.deep else lx.FENCE.match(self.text, self.start)
        if not found:
            return None
        code = self.add(block, "CodeBlock", self.start + 1)
        size = found.end() - found.start()
        code.state = {"fenced": True, "char": self.at(self.start), "size": min(size, MAX_FENCE), "margin": self.start - self.offset}
        self.advance(found.end() - self.offset)
        rest = self.text[self.offset :].rstrip(b"\r\n")
        info = lx.unescape(lx.decode_entities(rest).strip(lx.SPACES))
        code.fields = {"info": info or None, "fenced": True, "closed": False}
        return code

    def html(self, block: Block) -> Block | None:
        if self.deep or self.at(self.start) != 0x3C:
            return None
        kind = next((n for n, pattern in lx.HTML_STARTS if pattern.match(self.text, self.start)), 0)
        if not kind and block.kind != "Paragraph" and lx.HTML_START_7.match(self.text, self.start):
            kind = 7
        if not kind:
            return None
        found = self.add(block, "HTMLBlock", self.start + 1)
        found.state["type"] = kind
        return found

    def setext(self, block: Block) -> Block | None:
        found = lx.SETEXT.match(self.text, self.start) if block.kind == "Paragraph" and not self.deep else None
        if not found:
            return None
        if self.harvest(block, False):
            block.kind = "Heading"
            block.fields["level"] = 1 if found[1][:1] == b"=" else 2
            block.state["setext"] = True
            self.advance(len(self.text) - 1 - self.offset)
        return block

    def rule(self, block: Block) -> Block | None:
        if self.deep or (block.kind == "Paragraph" and not self.whole) or not lx.RULE.match(self.text, self.start):
            return None
        found = self.add(block, "ThematicBreak", self.start + 1)
        self.advance(len(self.text) - 1 - self.offset)
        return found

    def note(self, block: Block) -> Block | None:
        if self.deep or not self.options.footnotes or self.depth >= MAX_DEPTH:
            return None
        found = lx.NOTE_OPEN.match(self.text, self.start)
        if not found:
            return None
        self.advance(found.end() - self.offset)
        size = found.end() - found.start()
        definition_ = self.add(block, "FootnoteDefinition", self.start + size + 1)
        definition_.fields["label"] = found[1]
        definition_.inline_offset = size
        key = lx.fold_label(found[1])
        if key is not None:
            self.notes.add(key)
        return definition_

    def item(self, block: Block) -> Block | None:
        if (self.deep and block.kind != "List") or self.indent >= 4 or self.depth >= MAX_DEPTH:
            return None
        marker = self.marker(block.kind == "Paragraph")
        if marker is None:
            return None
        size, sort, number = marker
        start, indent = self.start, self.indent
        self.advance(start + size - self.offset)
        saved = self.split_tab, self.offset, self.column
        while self.column - saved[2] <= 5 and self.at(self.offset) in (0x20, 0x09):
            self.advance(1, True)
        gap = self.column - saved[2]
        if gap >= 5 or gap < 1 or self.at(self.offset) in (0x0A, 0x0D):
            padding = size + 1
            self.split_tab, self.offset, self.column = saved
            if gap > 0:
                self.advance(1, True)
        else:
            padding = size + gap
        if block.kind != "List" or block.state["sort"] != sort:
            block = self.add(block, "List", start + 1)
            block.state["sort"] = sort
            block.fields = {"flavor": "bullet" if number is None else "ordered", "start": number}
        found = self.add(block, "ListItem", start + 1)
        found.state = {"margin": indent, "padding": padding}
        found.fields["checked"] = None
        return found

    def marker(self, interrupts: bool) -> tuple[int, bytes, int | None] | None:
        """Size, sort and number of the list marker at the start."""
        text, at = self.text, self.start
        end, number = at + 1, None
        if self.at(at) in b"*-+":
            sort = text[at:end]
        else:
            end = at
            while end - at < 9 and 0x30 <= self.at(end) <= 0x39:
                end += 1
            if end == at or self.at(end) not in (0x2E, 0x29):
                return None
            number = int(text[at:end])
            if interrupts and number != 1:
                return None
            sort = text[end : end + 1]
            end += 1
        if self.at(end) not in (0x20, 0x09, 0x0A, 0x0D):
            return None
        if interrupts:
            rest = end
            while self.at(rest) in (0x20, 0x09):
                rest += 1
            if self.at(rest) == 0x0A or (number is not None and self.at(rest) == 0x0D):
                return None
        return end - at, sort, number

    def indented(self, block: Block) -> Block | None:
        if not self.deep or self.lazy or self.blank:
            return None
        self.advance(CODE_INDENT, True)
        code = self.add(block, "CodeBlock", self.offset + 1)
        code.state["fenced"] = False
        code.fields = {"info": None, "fenced": False, "closed": True}
        return code

    # -- extensions ----------------------------------------------------------------------------------------------------

    def task(self, block: Block) -> None:
        found = lx.TASK.match(self.text, self.start) if block.kind == "ListItem" else None
        if found:
            self.advance(3)
            block.fields["checked"] = found[1] != b" "

    def formula(self, block: Block) -> Block | None:
        if self.deep:
            return None
        for mark, end in ((b"\\\\[", b"\\\\]"), (b"$$", b"$$")):
            if self.text.startswith(mark, self.start) and lx.BLANK_REST.match(self.text, self.start + len(mark)):
                found = self.add(block, "FormulaBlock", self.start + 1)
                found.state = {"mark": end, "done": False}
                found.fields["mode"] = "standalone"
                self.advance(len(self.text) - self.offset)
                return found
        return None

    def directive(self, block: Block) -> Block | None:
        text, start = self.text, self.start
        colons = _run(text, start, 0x3A)
        if self.deep or colons < 2:
            return None
        at = start + colons
        end = attrs.name_end(text, at)
        if end == at:
            return None
        name, label, found = text[at:end], None, None
        if text[end : end + 1] == b"[":
            close = attrs.label_end(text, end)
            if close < 0:
                return None
            label, end = (end, close), close
        if text[end : end + 1] == b"{":
            close = attrs.block_end(text, end)
            found = attrs.attributes(text[end + 1 : close - 1]) if close >= 0 else None
            if found is None:
                self.diagnostics.append((self.number, end + 1, self.number, len(text.rstrip(b" \t\r\n"))))
            else:
                end = close
        if not lx.BLANK_REST.match(text, end):
            return None
        node = self.add(block, "DirectiveBlock", start + 1)
        node.state = {"fence": colons, "done": colons == 2, "swallow": True}
        node.fields = {"mode": "standalone", "name": name, "attributes": found}
        if label is not None:
            inner = Block("DirectiveLabel", self.number, start + label[0] + 1)
            inner.is_open, inner.inline_offset = False, 1
            inner.ecol = start + label[1]
            inner.content += text[label[0] + 1 : label[1] - 1]
            node.append(inner)
        self.advance(len(text) - self.offset)
        return node

    def table(self, block: Block) -> Block | None:
        if self.deep:
            return None
        if block.kind == "Paragraph":
            return self.table_header(block)
        return self.table_row(block) if block.kind == "Table" else None

    def table_header(self, block: Block) -> Block | None:
        if "no_table" in block.state or not lx.TABLE_START.match(self.text, self.start):
            return None
        rule = scan_row(self.text[self.start :])
        if rule is None:
            return None
        content = bytes(block.content)
        header = scan_row(content)
        if header is None or len(header[0]) != len(rule[0]):
            block.state["no_table"] = True
            return None
        cells, lead = header
        begin, line, byte, _ = self.marks[-1]
        block.kind, block.fields = "Table", {"alignments": [_alignment(text) for _, _, _, text in rule[0]]}
        block.state = {"filled": 0}
        if lead:
            self.lead(block, content, lead)
            block.line, block.col = line, byte + 1
        row = block.append(Block("TableRow", block.line, block.col))
        row.fields["is_header"] = True
        row.ecol = block.col + len(content) - begin - 2
        for start, end, inner, text in cells:
            cell = row.append(Block("TableCell", block.line, block.col + start - begin))
            cell.ecol, cell.inline_offset = block.col + end - begin, inner
            cell.content += text
        self.advance(len(self.text) - 1 - self.offset)
        return block

    def lead(self, block: Block, content: bytes, size: int) -> None:
        """The lines above a table's header stay behind as a paragraph."""
        paragraph = Block("Paragraph", block.line, block.col)
        paragraph.is_open = False
        paragraph.content += content[:size].strip(lx.SPACES)
        last = len(content[:size].rstrip(b"\n \t"))
        cursor = 0
        while cursor + 1 < len(self.marks) and self.marks[cursor + 1][0] <= last - 1:
            cursor += 1
        begin, line, byte, pad = self.marks[cursor]
        paragraph.eline, paragraph.ecol = line, _byte_column(begin, byte, pad, last - 1) + 1
        block.put_before(paragraph)

    def table_row(self, block: Block) -> Block | None:
        if self.blank or block.state["filled"] > MAX_FILLED_CELLS:
            return None
        start, found = self.row  # of on_table, unless what the table is in has changed where the row starts
        if start != self.start:
            found = scan_row(self.text[self.start :])
        if found is None:
            return None
        row = self.add(block, "TableRow", block.col)
        row.ecol = block.ecol
        row.fields["is_header"] = False
        columns = len(block.fields["alignments"])
        for start, end, inner, text in found[0][:columns]:
            cell = row.append(Block("TableCell", self.number, block.col + start))
            cell.ecol, cell.inline_offset = block.col + end, inner
            cell.content += text
        for _ in range(columns - len(found[0])):
            row.append(Block("TableCell", self.number, 0))
            block.state["filled"] += 1
        self.advance(len(self.text) - 1 - self.offset)
        return row


# -- pieces --------------------------------------------------------------------------------------------------------------


#: How an open block of a kind meets a line; kinds that are not here go on.
_MATCHERS = {
    "BlockQuote": Machine.on_quote, "ListItem": Machine.on_item, "CodeBlock": Machine.on_code, "Heading": lambda m, b: NO,
    "HTMLBlock": Machine.on_html, "FootnoteDefinition": Machine.on_note, "Table": Machine.on_table, "TableRow": lambda m, b: NO,
    "TableCell": lambda m, b: NO, "FormulaBlock": Machine.on_formula, "DirectiveBlock": Machine.on_directive,
}
_SETTLERS = {"Paragraph": Machine.settle_paragraph, "CodeBlock": Machine.settle_code, "HTMLBlock": Machine.settle_html, "List": Machine.settle_list}


def _ends_with_line(block: Block) -> bool:
    """Whether a block, while a line is taken, ends with that line and not with the one before."""
    kind = block.kind
    return kind == "Document" or (kind == "CodeBlock" and block.state["fenced"]) or (kind == "Heading" and "setext" in block.state)


@lru_cache
def _openers(options) -> tuple[tuple, tuple[tuple, ...]]:
    """What may open a block, in order of precedence, and of that what may by a line's first byte where no code is indented
    and no table open."""
    m = Machine
    first = {
        m.quote: b">", m.atx: b"#", m.fence: b"`~", m.html: b"<", m.setext: b"=-", m.rule: b"*_-", m.note: b"[", m.item: b"*-+0123456789", m.indented: b"",
        m.task: b"[", m.formula: b"\\$", m.directive: b":", m.table: b"|:-\v\f",
    }
    off = ((options.task_lists, m.task), (options.formulas, m.formula), (options.directives, m.directive), (options.tables, m.table))
    every = tuple(f for f in first if all(on or f is not g for on, g in off))
    return every, tuple(tuple(f for f in every if c in first[f]) for c in range(256))


def _run(text: bytes, at: int, c: int) -> int:
    end = at
    while end < len(text) and text[end] == c:
        end += 1
    return end - at


def _byte_column(begin: int, byte: int, pad: int, at: int) -> int:
    """Byte column of content offset `at` in a line that was added from `byte` on, `pad` spaces standing for a tab."""
    inside = at - begin
    return byte if inside < pad else byte + (1 if pad else 0) + inside - pad


def _without_closing_hashes(line: bytes) -> bytes:
    line = line.rstrip(lx.SPACES)
    bare = line.rstrip(b"#")
    return bare.rstrip(lx.SPACES) if len(bare) < len(line) and bare[-1:] in (b" ", b"\t") else line


def _without_blank_tail(code: bytes) -> bytes:
    """Up to the end of the last line that is not blank, without its line end."""
    bare = code.rstrip(b" \t\r\n")
    for k in range(len(bare), len(code)):
        if code[k] in b"\r\n":
            return code[:k]
    return code


def _ends_blank(block: Node) -> bool:
    """Whether a block ends with a blank line, its last item's last block counting for a list."""
    trail = []
    while True:
        if not isinstance(block, Block):
            answer = False
            break
        if block.checked_blank is not None:
            answer = block.checked_blank
            break
        trail.append(block)
        if block.kind not in ("List", "ListItem") or block.last is None:
            answer = block.last_blank
            break
        block = block.last
    for passed in trail:
        passed.checked_blank = answer
    return answer


def _is_loose(block: Block) -> bool:
    for item in block:
        if item.last_blank and item.next is not None:
            return True
        for child in item:
            if (item.next is not None or child.next is not None) and _ends_blank(child):
                return True
    return False


def _raw_label(text: bytes) -> bytes:
    k = 1
    while k < len(text) and text[k] != 0x5D:
        k += 2 if text[k] == 0x5C and k + 1 < len(text) else 1
    return text[1:k]


def _alignment(text: bytes) -> str:
    left, right = text[:1] == b":", text[-1:] == b":"
    return "center" if left and right else "left" if left else "right" if right else "none"


def _over_spaces(data: bytes, at: int) -> int:
    while at < len(data) and data[at] in b" \t":
        at += 1
    return at


def _over_line_end(data: bytes, at: int) -> int:
    """Offset behind the line end at `at`, or -1 if there is none; the end of the data is a line end."""
    if at >= len(data):
        return at
    if data[at : at + 2] == b"\r\n":
        return at + 2
    return at + 1 if data[at] in b"\r\n" else -1


def _over_break(data: bytes, at: int) -> int:
    """Spaces, at most one line end, spaces."""
    at = _over_spaces(data, at)
    end = _over_line_end(data, at)
    return _over_spaces(data, end) if end > at else at


def definition(data: bytes, at: int) -> tuple[bytes, bytes, bytes, int] | None:
    """Label, destination, title (raw) and end of the link definition at `at`."""
    label, end = link_label(data, at)
    if not label or data[end : end + 1] != b":":
        return None
    found = link_destination(data, _over_break(data, end + 1))
    if found is None:
        return None
    url, before = found
    start = _over_break(data, before)
    title = lx.TITLE.match(data, start) if start > before else None
    if title:
        end = _over_line_end(data, _over_spaces(data, title.end()))
        if end >= 0:
            return label, url, title[0], end
    end = _over_line_end(data, _over_spaces(data, before))
    return (label, url, b"", end) if end >= 0 else None


#: A line that begins with a pipe, with something in each cell but the last and no byte that is more than itself.
_PLAIN_ROW = re.compile(rb"\|(?: *+[^|\r\n\0\\ \t\v\f][^|\r\n\0\\\t\v\f]*+\|)*+(?: *+[^|\r\n\0\\ \t\v\f][^|\r\n\0\\\t\v\f]*+)?+\r?\n")


def scan_row(text: bytes) -> tuple[list[tuple[int, int, int, bytes]], int] | None:
    """The cells of a table row as (start, last byte, spaces before the text, text), and where its line begins.

    Of several lines the last one counts; None if the text is no row.
    """
    if _PLAIN_ROW.fullmatch(text):
        body, at = text.rstrip(b"\r\n"), 1
        parts = body[1:].split(b"|")
        if not parts[-1].strip(lx.SPACES):
            parts.pop()
        if len(parts) > MAX_CELLS:
            return None
        cells = []
        for part in parts:
            cell = part.lstrip(b" ")
            end = at + len(part)
            cells.append((at, end - 1, len(part) - len(cell), cell.rstrip(b" ")))
            at = end + 1
        if cells:
            return cells, 0
    cells: list[tuple[int, int, int, bytes]] = []
    first, size = 0, len(text)
    found = lx.CELL_END.match(text)
    at, more = found.end() if found else 0, True
    while at < size and more:
        cell = lx.CELL.match(text, at)
        end = cell.end() if cell else at
        pipe = lx.CELL_END.match(text, end)
        if cell or pipe:
            if len(cells) >= MAX_CELLS:
                return None
            start, inner = at, 0
            while start > first and text[start - 1] != 0x7C:
                start -= 1
                inner += 1
            cells.append((start, end - 1, inner, text[at:end].replace(b"\\|", b"|").strip(lx.SPACES)))
        at = pipe.end() if pipe else end
        if not pipe:
            stop = lx.ROW_END.match(text, at)
            if stop:
                at = stop.end()
            if stop and at != size:
                first, cells = at, []
                found = lx.CELL_END.match(text, at)
                at = found.end() if found else at
            else:
                more = False
    return (cells, first) if at == size and cells else None

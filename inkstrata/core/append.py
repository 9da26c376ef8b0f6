"""Documents that grow: appended chunks, nodes that keep their identity, and revisions that say what changed.

A growing document reads each line about once. Closed blocks of the top level are settled: no later line changes them, so an
append parses from the start of the last block on, with the lines before it only counted. What a later line can change is
what a label means: each settled unit is listed under the labels that its brackets asked for, and when one of those comes
to be defined, or its definition goes, just these units are scanned again. So a chunk costs its own length, that of the block
it goes on with, and the units it turns; one block that never ends (a single list or table) is parsed whole each time.

Nodes of what was parsed anew are paired with those that stood there before: children that are equal in all they show, at
the front and at the back, then the longest common run of the rest as far as a bounded edit distance finds it, then those of
the same kind in the same place. A paired node keeps its id; its revision moves only when something it shows, its children
or anything below it has changed. Ids are never used again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import xxhash

from inkstrata.core import document as md
from inkstrata.core import lexis as lx
from inkstrata.core.blocks import Machine
from inkstrata.core.inlines import Context
from inkstrata.core.tree import Block, Node

#: Bounds of the edit distance that pairs the middle of two child lists.
MAX_EDITS = 64
_BRACKET = re.compile(rb" {0,3}\[")
#: Paragraphs of one line of words each, the last of which may go on; no syntax has any other meaning for such text.
_LINE = rb"[A-Za-z][0-9A-Za-z]*+(?: [0-9A-Za-z]++)*+"
_WORDS = re.compile(rb"(?:" + _LINE + rb"(?:\n\n++" + _LINE + rb")*+\n*+)?+")
_WORD_LINE = re.compile(rb"[^\n]++")


class Superseded(ValueError):
    """A chunk for a revision that is no longer the last, or for a chain that has failed."""


@dataclass(slots=True)
class Kept:
    """What is kept of a node between revisions."""

    id: int
    revision: int
    kind: str
    own: bytes
    whole: bytes
    children: list[Kept]


def _summary(root: Node) -> Kept:
    """The tree as digests of what each node shows (its place aside) and of all below it; ids are not set."""
    stack: list[Kept] = []
    top = None
    for node, _, entering in root.walk():
        if entering:
            shown = b"".join([name.encode() + b"\0" + value + b"\0" for name, value in md.shown_fields(node)])
            kept = Kept(0, 0, node.kind, xxhash.xxh3_128_digest(node.kind.encode() + shown), b"", [])
            if stack:
                stack[-1].children.append(kept)
            stack.append(kept)
        else:
            top = stack.pop()
            top.whole = xxhash.xxh3_128_digest(b"".join([top.own, *[c.whole for c in top.children]]))
    return top


_PARAGRAPH = xxhash.xxh3_128_digest(b"Paragraph")


def _paragraph(text: bytes) -> Kept:
    """The summary of a paragraph of words."""
    own = xxhash.xxh3_128_digest(b'Textliteral\0"' + text + b'"\0')
    whole = xxhash.xxh3_128_digest(own)
    return Kept(0, 0, "Paragraph", _PARAGRAPH, xxhash.xxh3_128_digest(_PARAGRAPH + whole), [Kept(0, 0, "Text", own, whole, [])])


def _aligned(old: list[Kept], new: list[Kept]) -> list[tuple[int, int]]:
    """Pairs of places of equal subtrees in two lists, by Myers' edit script of at most MAX_EDITS changes; else none."""
    n, m = len(old), len(new)
    if {x.whole for x in old}.isdisjoint([x.whole for x in new]):
        return []
    reach, trail = {1: 0}, []
    for edits in range(min(MAX_EDITS, n + m) + 1):
        trail.append(dict(reach))
        for k in range(-edits, edits + 1, 2):
            x = reach[k + 1] if k == -edits or (k != edits and reach.get(k - 1, -1) < reach.get(k + 1, -1)) else reach[k - 1] + 1
            y = x - k
            while x < n and y < m and old[x].whole == new[y].whole:
                x, y = x + 1, y + 1
            reach[k] = x
            if x >= n and y >= m:
                out = []
                for d in range(edits, -1, -1):
                    before = trail[d]
                    k = x - y
                    up = k == -d or (k != d and before.get(k - 1, -1) < before.get(k + 1, -1))
                    px = before.get(k + 1, 0) if up else before.get(k - 1, -1)
                    py = px - (k + 1 if up else k - 1)
                    sx, sy = (px, py + 1) if up else (px + 1, py)
                    if d == 0:
                        sx, sy = 0, 0
                    while x > sx and y > sy:
                        x, y = x - 1, y - 1
                        out.append((x, y))
                    x, y = px, py
                return out[::-1]
    return []


def _pairs(old: list[Kept], new: list[Kept]) -> list[tuple[int, int]]:
    """Which children stand for which: equal ones first, then those of one kind in one place of each gap."""
    if not old or not new:
        return []
    if len(old) == len(new) == 1:
        return [(0, 0)] if old[0].kind == new[0].kind else []
    front = 0
    while front < min(len(old), len(new)) and old[front].whole == new[front].whole:
        front += 1
    back = 0
    while back < min(len(old), len(new)) - front and old[-1 - back].whole == new[-1 - back].whole:
        back += 1
    a, b = old[front : len(old) - back], new[front : len(new) - back]
    fixed = [(i, i) for i in range(front)]
    fixed += [(front + i, front + j) for i, j in _aligned(a, b)]
    fixed += [(len(old) - k, len(new) - k) for k in range(back, 0, -1)]
    out, i, j = [], 0, 0
    for p, q in [*fixed, (len(old), len(new))]:
        while i < p and j < q and old[i].kind == new[j].kind:
            out.append((i, j))
            i, j = i + 1, j + 1
        if p < len(old) or q < len(new):
            out.append((p, q))
        i, j = p + 1, q + 1
    return out


class Labels:
    """Defined labels, each as often as it is defined, with a record of those that were asked for."""

    def __init__(self):
        self.times: dict[bytes, int] = {}
        self.asked: set[bytes] = set()

    def __contains__(self, label: bytes) -> bool:
        self.asked.add(label)
        return label in self.times

    def count(self, labels: list[bytes], by: int, turned: dict[bytes, bool]) -> None:
        """Count definitions in or out; `turned` has what was defined before of the labels that are touched."""
        for label in labels:
            turned.setdefault(label, label in self.times)
            n = self.times.get(label, 0) + by
            if n:
                self.times[label] = n
            else:
                del self.times[label]


def _defined(top: Node) -> tuple[list[bytes], list[bytes]]:
    """The labels that the definitions and footnotes of a subtree define."""
    links, notes = [], []
    for node, _, entering in top.walk():
        if entering and node.kind in ("ReferenceDefinition", "FootnoteDefinition"):
            key = lx.fold_label(node.fields["label"].strip(lx.SPACES))
            if key is not None:
                (links if node.kind == "ReferenceDefinition" else notes).append(key)
    return links, notes


class Growing:
    """The tree of a document that takes chunks."""

    def __init__(self, options: md.Options):
        self.options, self._root = options, Block("Document", 1, 1)
        self._words: list[tuple[int, bytes]] | None = None  # line and text of paragraphs that the tree does not have yet
        self.lines, self.open = 0, b""  # lines before the frontier, bytes from it on
        self.tops: list[Node] = []  # settled children of the root
        self.links, self.notes = Labels(), Labels()
        self.loose: tuple[list[bytes], list[bytes]] = ([], [])  # labels defined behind the frontier
        self.askers: dict[tuple[int, bytes], dict[int, Block]] = {}
        self.found: dict[int, list[tuple]] = {}  # diagnostics of settled units
        self.settled_notes: list[tuple] = []
        self.loose_notes: list[tuple] = []
        self._heard: list[tuple] = []
        self.context = Context(options, self.links, self.notes, lambda *scope: self._heard.append(scope))

    @property
    def diagnostics(self) -> list[tuple]:
        return sorted([*self.settled_notes, *(x for own in self.found.values() for x in own), *self.loose_notes])

    def append(self, chunk: bytes) -> tuple[int, set[int]]:
        """Take a chunk; how many children of the root stand as they did, and which of those had units scanned again."""
        self._plant()
        kept, data = len(self.tops), self.open + chunk
        lines = md._LINES.findall(data)
        rest = lines.pop() if lines and not lines[-1].endswith(b"\n") else b""
        machine = Machine(self.options)
        machine.number = self.lines
        for line in lines:
            machine.feed(line.replace(b"\0", b"\xef\xbf\xbd"))
        settled = self._settled(machine, lines)
        if settled:
            passed = settled[1].line - self.lines - 1
            self.lines += passed
            data = data[sum(map(len, lines[:passed])) :]
        if rest:
            machine.feed(rest.replace(b"\0", b"\xef\xbf\xbd"))
        tree = machine.finish()
        self.open = data
        new = list(tree)
        for old in list(self._behind(kept)):
            old.detach()
        for top in new:
            self.root.append(top.detach())
        self.root.eline, self.root.ecol = tree.eline, tree.ecol
        fixed = settled[0] if settled else 0
        turned = self._count(new, fixed)
        self.settled_notes += [x for x in machine.diagnostics if x[0] <= self.lines]
        self.loose_notes = [x for x in machine.diagnostics if x[0] > self.lines]
        again = self._turn(turned)
        for place, top in enumerate(new):
            for block in [node for node, _, entering in top.walk() if entering and isinstance(node, Block)]:
                self._scan(block, kept + place if place < fixed else None)
        self.tops += new[:fixed]
        return kept, again

    @property
    def root(self) -> Block:
        self._plant()
        return self._root

    def words(self, chunk: bytes) -> tuple[int, list[bytes]] | None:
        """Take a chunk if from the frontier on there are only paragraphs of one line of words: how many children of the root
        stand as they did, and the texts behind them. The machine would make the same of it; the tree gets it when it is read.

        What stood behind the frontier was such text too, so that no label or diagnostic is to be taken back.
        """
        data = self.open + chunk
        if not _WORDS.fullmatch(data):
            return None
        if self._words is None:
            self._words = []
        elif self._words:
            self._words.pop()
        kept, line, at, last, texts = len(self.tops) + len(self._words), self.lines + 1, 0, 0, []
        for found in _WORD_LINE.finditer(data):
            last = found.start()
            line += last - at  # all between two lines of words are line ends
            at = found.end()
            texts.append(found[0])
            self._words.append((line, found[0]))
        self.lines, self.open, self.loose_notes = line - 1, data[last:], []
        return kept, texts

    def _plant(self) -> None:
        """Put into the tree what `words` has taken."""
        if self._words is None:
            return
        root, words, self._words = self._root, self._words, None
        for old in list(self._behind(len(self.tops))):
            old.detach()
        new = []
        for line, text in words:
            block = Block("Paragraph", line, 1)
            block.is_open, block.eline, block.ecol = False, line, len(text)
            block.content += text + b"\n"
            block.append(Node("Text", line, 1, line, len(text), literal=text))
            new.append(root.append(block))
        self.tops += new[:-1]
        root.eline = root.ecol = 0
        if words:
            ends = self.open.count(b"\n")
            root.eline, root.ecol = words[-1][0] + max(0, ends - 1), len(words[-1][1]) if ends < 2 else 0

    def _behind(self, kept: int):
        node = self.tops[kept - 1].next if kept else self._root.first
        while node is not None:
            following = node.next
            yield node
            node = following

    def _settled(self, machine: Machine, lines: list[bytes]) -> tuple[int, Node] | None:
        """How many children are settled, and the one that begins at the frontier, from whose first line a parse gives the same."""
        tops = list(machine.root)
        k = len(tops) - 1
        if k <= 0:
            return None
        touches = lambda i, kind: i > 0 and tops[i - 1].kind == kind and tops[i - 1].eline >= tops[i].line - 1
        last = tops[k]
        if last.kind == "Table" and touches(k, "Paragraph"):
            k -= 1  # the header was a line of that paragraph
        elif last.kind == "Heading" and "setext" in last.state:
            while touches(k, "ReferenceDefinition"):
                k -= 1
        elif last.kind in ("Paragraph", "ReferenceDefinition") and touches(k, "ReferenceDefinition") and not _BRACKET.match(lines[last.line - self.lines - 1]):
            return None  # indented as no block's first line may be
        if not k or any(isinstance(x, Block) and x.is_open for x in tops[:k]) or tops[k].line <= max(x.eline for x in tops[:k]):
            return None
        return k, tops[k]

    def _count(self, new: list[Node], fixed: int) -> list[tuple[int, bytes]]:
        """Count the labels of what came and went; those that are defined now and were not, or the other way round."""
        turned: tuple[dict[bytes, bool], dict[bytes, bool]] = ({}, {})
        tables = (self.links, self.notes)
        for table, labels, touched in zip(tables, self.loose, turned, strict=True):
            table.count(labels, -1, touched)
        self.loose = ([], [])
        for place, top in enumerate(new):
            for k, labels in enumerate(_defined(top)):
                tables[k].count(labels, 1, turned[k])
                if place >= fixed:
                    self.loose[k].extend(labels)
        return [(k, label) for k in (0, 1) for label, before in turned[k].items() if before != (label in tables[k].times)]

    def _turn(self, turned: list[tuple[int, bytes]]) -> set[int]:
        """Scan the settled units again that asked for a label whose meaning has turned; the places of their tops."""
        units = {key: block for label in turned for key, block in self.askers.get(label, {}).items()}
        places = set()
        for block in units.values():
            place, block.kind, block.fields = block.state["settled"]
            block.fields = dict(block.fields)
            block.first = block.last = None
            self._scan(block, place)
            places.add(place)
        return places

    def _scan(self, block: Block, place: int | None) -> None:
        """Parse a block's inlines; a settled one is listed under the labels it asks for."""
        self.links.asked, self.notes.asked, self._heard = set(), set(), []
        before = place, block.kind, dict(block.fields)
        md._refine(block, self.context)
        if place is None:
            self.loose_notes += self._heard
            return
        if self._heard or id(block) in self.found:
            self.found[id(block)] = self._heard
        asked = [(0, x) for x in self.links.asked] + [(1, x) for x in self.notes.asked]
        if asked:
            block.state["settled"] = before
            for key in asked:
                self.askers.setdefault(key, {})[id(block)] = block


class Chain:
    """The revisions of one growing document; only the last can be appended to."""

    def __init__(self, data: bytes = b"", options: md.Options = md.PROFILES["default"], series: int = 0):
        self.options, self.series = options, series
        self.chunks: list[bytes] = []
        self.revision, self.next_id, self.failed = 0, 1, False
        self.tree: Kept | None = None
        self.document = Growing(options)
        self.append(data)

    @property
    def data(self) -> bytes:
        if len(self.chunks) > 1:
            self.chunks = [b"".join(self.chunks)]
        return self.chunks[0] if self.chunks else b""

    def __getstate__(self) -> tuple:
        """The bytes and the identities; the tree is parsed again from them, once for a restored chain."""
        return self.options, self.series, self.data, self.revision, self.next_id, self.failed, self.tree

    def __setstate__(self, state: tuple) -> None:
        self.options, self.series, data, self.revision, self.next_id, self.failed, self.tree = state
        self.chunks, self.document = [data], Growing(self.options)
        self.document.append(data)

    def append(self, chunk: bytes, revision: int | None = None) -> Growing:
        """Append a chunk to the given (by default the last) revision; an empty chunk makes a revision too."""
        if self.failed or (revision is not None and revision != self.revision):
            raise Superseded(f"revision {revision} of a chain at {self.revision}")
        words = self.document.words(bytes(chunk)) if self.tree is not None else None
        if words is not None:
            self.chunks.append(bytes(chunk))
            self.revision += 1
            self._pair_words(*words)
            return self.document
        try:
            kept, again = self.document.append(bytes(chunk))
            new = [(place, _summary(self.document.tops[place])) for place in sorted(again)]
            tail = [_summary(top) for top in self._tail(kept)]
        except Exception:
            self.failed = True
            raise
        self.chunks.append(bytes(chunk))
        self.revision += 1
        self._pair(kept, new, tail)
        return self.document

    def _tail(self, kept: int) -> list[Node]:
        return list(self.document._behind(kept))

    def _pair_words(self, kept: int, texts: list[bytes]) -> None:
        """As _pair does, for paragraphs of words: the last one stands, goes on or is followed by new ones."""
        root, tail = self.tree, [_paragraph(text) for text in texts]
        below = root.children
        old = below[-1] if len(below) == kept + 1 else None
        if old is not None and old.whole == tail[0].whole:
            fresh = tail[1:]
        elif old is not None and len(tail) == 1 and old.kind == "Paragraph" and len(old.children) == 1 and old.children[0].kind == "Text":
            new, text, was = tail[0], tail[0].children[0], old.children[0]
            new.id, text.id, new.revision = old.id, was.id, self.revision
            text.revision = self.revision  # its literal is all that a text shows
            below[-1], root.revision = new, self.revision
            return
        elif len(below) == kept:
            fresh = tail
        else:
            self._pair(kept, [], tail)
            return
        for new in fresh:
            for node in (new, new.children[0]):
                node.id, node.revision = self.next_id, self.revision
                self.next_id += 1
            root.revision = self.revision
        below += fresh

    def _pair(self, kept: int, again: list[tuple[int, Kept]], tail: list[Kept]) -> None:
        """Give ids and revisions to what was parsed anew: children of the root at the places in `again`, and from `kept` on."""
        root = self.tree
        if root is None:
            self.tree = root = Kept(self.next_id, self.revision, "Document", b"", b"", [])
            self.next_id += 1
        old = root.children[kept:]
        taken = {j: old[i] for i, j in _pairs(old, tail)}
        work = [(root.children[place], new) for place, new in again] + [(taken.get(j), new) for j, new in enumerate(tail)]
        changed = [c.id for c in old]
        for place, new in again:
            root.children[place] = new
        root.children[kept:] = tail
        order: list[tuple[Kept | None, Kept]] = []
        work.reverse()
        while work:
            before, after = work.pop()
            taken = {}
            if before is not None:
                if before.whole == after.whole:
                    after.id, after.revision, after.children = before.id, before.revision, before.children
                    continue
                taken = {j: before.children[i] for i, j in _pairs(before.children, after.children)}
            order.append((before, after))
            work += [(taken.get(j), child) for j, child in reversed(list(enumerate(after.children)))]
        for before, after in order:  # in document order: new ids rise with it
            if before is None:
                after.id, after.revision = self.next_id, self.revision
                self.next_id += 1
            else:
                after.id = before.id
                after.revision = before.revision if before.whole == after.whole else self.revision
        for before, after in reversed(order):  # a child that is another node is a change of its parent
            if before is not None and [c.id for c in before.children] != [c.id for c in after.children]:
                after.revision = self.revision
            if any(c.revision == self.revision for c in after.children):
                after.revision = self.revision
        if changed != [c.id for c in tail] or any(after.revision == self.revision for _, after in order):
            root.revision = self.revision

    def identities(self) -> list[tuple[int, int]]:
        """(id, revision) of all nodes in document order."""
        out, work = [], [self.tree]
        while work:
            node = work.pop()
            out.append((node.id, node.revision))
            work += reversed(node.children)
        return out

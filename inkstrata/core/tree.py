"""Nodes, and the few list operations that parsing needs."""

from __future__ import annotations

from collections.abc import Iterator


class Node:
    """A node with its scope (1-based lines and byte columns) and its kind's fields; siblings are a linked list."""

    __slots__ = ("col", "ecol", "eline", "fields", "first", "kind", "last", "line", "next", "parent", "prev")

    def __init__(self, kind: str, line: int = 0, col: int = 0, eline: int = 0, ecol: int = 0, **fields):
        self.kind, self.fields = kind, fields
        self.line, self.col, self.eline, self.ecol = line, col, eline, ecol
        self.parent = self.prev = self.next = self.first = self.last = None

    def __iter__(self) -> Iterator[Node]:
        child = self.first
        while child is not None:
            following = child.next
            yield child
            child = following

    def append(self, child: Node) -> Node:
        child.parent, child.prev, child.next = self, self.last, None
        if self.last is None:
            self.first = child
        else:
            self.last.next = child
        self.last = child
        return child

    def detach(self) -> Node:
        if self.prev is not None:
            self.prev.next = self.next
        elif self.parent is not None:
            self.parent.first = self.next
        if self.next is not None:
            self.next.prev = self.prev
        elif self.parent is not None:
            self.parent.last = self.prev
        self.parent = self.prev = self.next = None
        return self

    def put_before(self, new: Node) -> Node:
        new.parent, new.prev, new.next = self.parent, self.prev, self
        if self.prev is not None:
            self.prev.next = new
        elif self.parent is not None:
            self.parent.first = new
        self.prev = new
        return new

    def put_after(self, new: Node) -> Node:
        if self.next is not None:
            return self.next.put_before(new)
        return self.parent.append(new)

    def take(self, first: Node | None, stop: Node | None) -> None:
        """Move the siblings from `first` up to but not including `stop` to the end of this node's children."""
        while first is not None and first is not stop:
            following = first.next
            self.append(first.detach())
            first = following

    def walk(self) -> Iterator[tuple[Node, int, bool]]:
        """Every node of the subtree in document order: (node, depth, entering); leaves enter and exit too."""
        node, depth, entering = self, 0, True
        while True:
            yield node, depth, entering
            if entering and node.first is not None:
                node, depth = node.first, depth + 1
            elif entering:
                entering = False
            elif node is self:
                return
            elif node.next is not None:
                node, entering = node.next, True
            else:
                node, depth = node.parent, depth - 1


class Block(Node):
    """A block while lines arrive: whether it is open, the text it has gathered, and what its kind needs to go on."""

    __slots__ = ("checked_blank", "content", "inline_offset", "is_open", "last_blank", "state")

    def __init__(self, kind: str, line: int, col: int):
        super().__init__(kind, line, col, line, 0)
        self.is_open, self.last_blank, self.checked_blank = True, False, None
        self.content, self.inline_offset, self.state = bytearray(), 0, {}

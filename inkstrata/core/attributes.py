"""Names, labels and attribute blocks of directives."""

from __future__ import annotations

from inkstrata.core.lexis import DIRECTIVE_NAME, PUNCTUATION, UNICODE_SPACES, code_point

_SPACES = b" \t\n\v\f\r"
_UNQUOTED_NEVER = b"\"'<=>`"


def name_end(data: bytes, at: int) -> int:
    """Where the directive name at `at` ends; `at` if there is none."""
    found = DIRECTIVE_NAME.match(data, at)
    if not found or found[0][:1] in (b"-", b"_") or found[0][-1:] in (b"-", b"_"):
        return at
    return found.end()


def label_end(data: bytes, at: int) -> int:
    """Offset behind the bracketed label at `at`; -1 if it does not close."""
    depth, k = 1, at + 1
    while k < len(data):
        c = data[k]
        if c == 0x5C and k + 1 < len(data):
            k += 2
            continue
        if c == 0x5B:
            depth += 1
        elif c == 0x5D:
            depth -= 1
            if not depth:
                return k + 1
        k += 1
    return -1


def block_end(data: bytes, at: int) -> int:
    """Offset behind the braces at `at`, quotes respected; -1 if they do not close."""
    k = at + 1
    while k < len(data):
        c = data[k]
        if c in b"\"'":
            k = data.find(bytes((c,)), k + 1)
            if k < 0:
                return -1
        elif c == 0x7D:
            return k + 1
        k += 1
    return -1


_STARTS, _INNER = frozenset(b"-_"), frozenset(b"-_:.")


def _is_name(code: int) -> bool:
    return code in _INNER or (code not in UNICODE_SPACES and code not in PUNCTUATION)


def _is_start(code: int) -> bool:
    return code in _STARTS or (code not in UNICODE_SPACES and code not in PUNCTUATION)


def _value(data: bytes, at: int) -> tuple[bytes, int] | None:
    while at < len(data) and data[at] in _SPACES:
        at += 1
    if at >= len(data):
        return None
    if data[at] in b"\"'":
        end = data.find(data[at : at + 1], at + 1)
        if end < 0 or (end + 1 < len(data) and data[end + 1] not in _SPACES and data[end + 1] != 0x7D):
            return None
        return data[at + 1 : end], end + 1
    end = at
    while end < len(data) and data[end] not in _SPACES:
        if data[end] in _UNQUOTED_NEVER:
            return None
        end += 1
    return data[at:end], end


def attributes(data: bytes) -> dict[bytes, bytes] | None:
    """The pairs between the braces; None if they are not attributes.

    A repeated name keeps its first place and last value; classes are joined.
    """
    out: dict[bytes, bytes] = {}
    classes: list[bytes] = []
    at = 0
    while True:
        while at < len(data) and data[at] in _SPACES:
            at += 1
        if at >= len(data):
            break
        value = b""
        if data[at] in b"#.":
            name, start = (b"id" if data[at] == 0x23 else b"class"), at + 1
            at = start
            while at < len(data) and _is_name(data[at]) and data[at] not in b".#":
                at += 1
            if at == start:
                return None
            value = data[start:at]
        else:
            start, first = at, True
            while at < len(data):
                code, width = code_point(data, at)
                if not width or not (_is_start(code) if first else _is_name(code)):
                    break
                at, first = at + width, False
            if at == start:
                return None
            name = data[start:at]
            while at < len(data) and data[at] in _SPACES:
                at += 1
            if data[at : at + 1] == b"=":
                found = _value(data, at + 1)
                if found is None:
                    return None
                value, at = found
        if name == b"class":
            classes.append(value)
            # the pieces are joined by one space once something has been written
            value = b""
            for piece in classes:
                value = value + b" " + piece if value else piece
        out[name] = value
    return out

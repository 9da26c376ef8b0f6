"""`python -m inkstrata [--profile NAME] [FILE ...]`: print the canonical dump of files, joined into one document, or of stdin."""

from __future__ import annotations

import argparse
import sys

from inkstrata.core.document import PROFILES, dump, parse


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="inkstrata", description="Print the canonical dump of Markdown files, joined into one document.")
    parser.add_argument("--profile", choices=sorted(PROFILES), default="default")
    parser.add_argument("files", nargs="*")
    options = parser.parse_args(arguments)
    parts = []
    for name in options.files:
        with open(name, "rb") as file:
            parts.append(file.read())
    data = b"".join(parts) if options.files else sys.stdin.buffer.read()
    sys.stdout.buffer.write(dump(parse(data, PROFILES[options.profile]).root))
    sys.stdout.flush()
    return 0


if __name__ == "__main__":
    sys.exit(main())

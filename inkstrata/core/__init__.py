"""The parser itself: bytes to a tree of nodes, without any Spark."""

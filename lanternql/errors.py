"""Errors of the query language."""


class QueryError(Exception):
    """A query that can't be run: ``reason`` names the kind, ``detail`` what it is about."""

    def __init__(self, reason: str, *detail):
        self.reason, self.detail = reason, detail
        super().__init__(f"{reason}: {', '.join(map(str, detail))}" if detail else reason)


class ParseError(QueryError):
    def __init__(self, message: str, line: int | None = None):
        super().__init__("parse_error", message if line is None else f"line {line}: {message}")

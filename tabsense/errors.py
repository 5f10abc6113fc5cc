"""Coded errors, so callers can map failures to messages without parsing text."""

from __future__ import annotations


class TabsenseError(Exception):
    """An error with a stable machine-readable ``code`` and keyword details."""

    def __init__(self, code: str, **details):
        self.code = code
        self.details = details
        extra = ", ".join(f"{k}={v}" for k, v in details.items())
        super().__init__(f"{code}({extra})" if extra else code)


class NotFound(TabsenseError):
    """A named table, column or entry does not exist."""


class WriteBlocked(TabsenseError):
    """A write or DDL statement was submitted without confirmation."""

    def __init__(self, sql_class: str, sql: str):
        super().__init__("writeNotConfirmed", sql_class=sql_class)
        self.sql_class = sql_class
        self.sql = sql

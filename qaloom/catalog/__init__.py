"""Registered queries over the driver tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from qaloom.catalog import answers, chats, files, lexical, ranking, rows, vectors

_MODULES = (lexical, vectors, ranking, rows, chats, answers, files)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}

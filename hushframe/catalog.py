"""The queries over the given tables, by name, and the SQL they are checked against."""

from __future__ import annotations

from .plans import audits, layouts, names, pictures, planted, running, screens, streams, texts, timeline

QUERIES = texts.QUERIES | streams.QUERIES | layouts.QUERIES | running.QUERIES | audits.QUERIES | pictures.QUERIES | planted.QUERIES | timeline.QUERIES | names.QUERIES | screens.QUERIES
SQL = texts.SQL | streams.SQL | layouts.SQL | running.SQL | audits.SQL | pictures.SQL | planted.SQL | timeline.SQL | names.SQL | screens.SQL

"""All queries of this subpackage and their SQL."""

from . import bm25, decontaminate, langid, lm, neardup, pieces, substring, suffixes, toxicity, warc

_ALL = (langid, pieces, toxicity, decontaminate, substring, neardup, warc, lm, suffixes, bm25)
QUERIES = {name: fn for m in _ALL for name, fn in m.QUERIES.items()}
SQL = {name: sql for m in _ALL for name, sql in m.SQL.items()}

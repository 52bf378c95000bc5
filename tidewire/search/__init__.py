"""Full-text search: analysis, query grammar, postings, ranking, highlighting, similar titles."""

from tidewire.search.engine import build_postings, search
from tidewire.search.index import SearchIndex

__all__ = ["SearchIndex", "build_postings", "search"]

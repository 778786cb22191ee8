"""All queries over the given tables."""

from . import build_queries, change_queries, depth_queries, kb_queries, more_queries, run_queries, stream_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

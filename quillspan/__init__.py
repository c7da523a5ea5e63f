"""Span analytics on Spark: dictionary labelling, span algebra, evaluation and annotation workflows."""

from quillspan.session import session

__all__ = ["session"]

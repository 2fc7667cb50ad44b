"""Community-signal analytics on Spark DataFrames."""

from chatterlens.session import build_session
from chatterlens.sources.corpus import Corpus, read_corpus

__all__ = ["Corpus", "build_session", "read_corpus"]

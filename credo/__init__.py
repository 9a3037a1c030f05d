"""credo: statement-credibility analytics on Spark.

Cleans, de-duplicates and splits labelled statement tables, derives
leakage-free credibility lookups from the training split, joins them back
as features, trains and scores a class-weighted classifier, tunes the
decision threshold, reports exact metrics and explains each decision --
all as DataFrame / SQL / Spark ML / Structured Streaming jobs.
"""

from credo.session import get_session, scratch_dir  # noqa: F401

__all__ = ["get_session", "scratch_dir"]

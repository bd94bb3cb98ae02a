"""All queries of the core with their SQL."""

from glasra.plans import corpus, manifest, roundtrips, scoring, selection
from glasra.plans.corpus import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "corpus", "manifest", "roundtrips", "scoring", "selection"]

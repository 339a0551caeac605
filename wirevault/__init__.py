"""wirevault: a Spark-native archive of HTTP request/response records."""

from .archive import Archive
from .operators.search import match_flows, ranked_search, search, search_summaries
from .operators.tagging import RULES, PythonRule, Rule, RuleSet
from .session import configure

__all__ = [
    "Archive", "RULES", "PythonRule", "Rule", "RuleSet", "configure",
    "match_flows", "ranked_search", "search", "search_summaries",
]

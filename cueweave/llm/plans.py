"""All queries of this subpackage with their SQL."""

from . import decontaminate, exact_dedup, html_text, language_id, ngram_join, packing, periodic_runs, prefix_forest, private_data, secrets, token_files, url_rules, whitening  # noqa: F401
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

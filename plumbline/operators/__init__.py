from plumbline.operators.categories import category_distance, category_levels, category_shares
from plumbline.operators.distributions import ks_statistics
from plumbline.operators.keys import key_duplicates, key_summary
from plumbline.operators.moments import correlations, moments
from plumbline.operators.ordering import order_gaps, order_summary
from plumbline.operators.profiles import distinct_counts, profile
from plumbline.operators.selection import quantiles
from plumbline.operators.references import (
    Edge,
    orphan_keys,
    reference_check,
    reference_summary,
)
from plumbline.operators.reporting import findings, report
from plumbline.operators.rules import rule_check

__all__ = [
    "Edge",
    "category_distance",
    "category_levels",
    "category_shares",
    "correlations",
    "distinct_counts",
    "findings",
    "key_duplicates",
    "key_summary",
    "ks_statistics",
    "moments",
    "order_gaps",
    "order_summary",
    "orphan_keys",
    "profile",
    "quantiles",
    "reference_check",
    "reference_summary",
    "report",
    "rule_check",
]

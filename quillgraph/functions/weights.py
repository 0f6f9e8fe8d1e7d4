"""Edge weights and traversal costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relation, control class, base weight; anything else is ("soft", 0.3).
RELATIONS = (
    ("director_of", "hard", 1.0),
    ("officer_of", "hard", 0.9),
    ("ten_percent_owner_of", "hard", 1.0),
    ("beneficial_owner_of", "hard", 0.9),
    ("subsidiary_of", "hard", 1.0),
    ("ultimately_owned_by", "hard", 0.9),
    ("owns", "hard", 0.9),
    ("veto_right_over", "hard", 1.0),
    ("trustee_of", "hard", 0.9),
    ("position_at", "hard", 0.7),
    ("hierarchy", "hard", 0.7),
    ("holds_shares_of", "soft", 0.5),
    ("funded_by", "soft", 0.6),
    ("grant_awarded_to", "soft", 0.6),
    ("principal_investigator_of", "soft", 0.6),
    ("author_of", "soft", 0.4),
    ("affiliated_with", "soft", 0.5),
    ("advisor_to", "soft", 0.5),
    ("member_of", "soft", 0.4),
    ("donated_to", "soft", 0.6),
    ("lobbying_tie", "soft", 0.6),
    ("family_of", "soft", 0.5),
    ("educated_at", "soft", 0.2),
    ("transaction_with", "soft", 0.4),
    ("professional_tie", "soft", 0.4),
    ("social_tie", "soft", 0.2),
    ("related_to", "soft", 0.2),
)
SCALED_BY_PERCENT = ("beneficial_owner_of", "holds_shares_of", "owns")


def _lookup(relation: Column, values: dict, default) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(table[F.lower(relation)], F.lit(default))


def control_class(relation: Column) -> Column:
    return _lookup(relation, {r: c for r, c, _ in RELATIONS}, "soft")


def conflict_weight(relation: Column, former: Column, percent: Column) -> Column:
    """Base weight; halved if former; then scaled by the share held, for holdings; three decimals."""
    w = _lookup(relation, {r: w for r, _, w in RELATIONS}, 0.3)
    w = F.when(F.coalesce(former, F.lit(False)), w / 2).otherwise(w)
    scaled = F.when(percent == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), w * (0.6 + percent / 25)))
    return F.round(F.when(percent.isNotNull() & F.lower(relation).isin(*SCALED_BY_PERCENT), scaled).otherwise(w), 3)


def edge_cost(weight: Column) -> Column:
    """Cost of a hop by strength; an unknown weight is the weakest. Replaceable wherever a search takes ``cost``."""
    return 1 - F.coalesce(weight, F.lit(0.0)) + 0.01

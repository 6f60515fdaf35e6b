"""All registered queries."""

from popgraph.plans import (  # noqa: F401
    base_views,
    build_plans,
    graph_plans,
    learning_plans,
    population_plans,
    reco_plans,
)
from popgraph.plans.registry import oracle_sql, queries  # noqa: F401

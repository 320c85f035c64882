"""Wiring of the operators to the benchmark tables; importing fills the query catalog."""

from civicspark.plans.registry import ORACLES, QUERIES  # noqa: F401
from civicspark.plans import (  # noqa: F401
    q_analytics,
    q_catalog,
    q_elections,
    q_geo,
    q_ingest,
    q_profile,
    q_reshape,
    q_resolve,
    q_sources,
    q_state,
    q_streams,
)

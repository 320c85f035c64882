"""Table schemas of the municipal data model."""

from __future__ import annotations

GEO_COORDS = "array<array<array<array<double>>>>"  # polygons > rings > points > [lon, lat]

STATISTICS = (
    "dataset_id string, period_type string, period_label string, period_year int, "
    "period_quarter int, period_month int, spatial_unit string, spatial_key string, "
    "spatial_code string, metric_name string, metric_value double, metric_unit string"
)
STATISTICS_KEY = ("dataset_id", "period_label", "spatial_unit", "spatial_key", "metric_name")

FEATURE_KEY = ("dataset_id", "dedup_key")
COUNT_KEY = ("counter_id", "count_period", "period_start")
ELECTION_KEY = ("election_id", "level", "gebiet_code", "party")

"""Imports every plan module, so that each registers its queries."""

from helixframe.plans import calling_queries, count_queries, function_queries, interval_queries, output_queries, read_queries, site_queries, track_queries, variant_queries  # noqa: F401

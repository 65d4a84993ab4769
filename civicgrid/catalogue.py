"""All queries by name, with the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from civicgrid.functions import queries as texts
from civicgrid.operators import admin, aggregates, dedup, incremental, lifecycle, listing, mentions, merge, postings, provenance, records, requests, scoring, serving, sketches
from civicgrid.plans import passes, planning
from civicgrid.streaming import capture, counters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

for _module in (aggregates, listing, planning, merge, texts, scoring, serving, counters, capture, sketches, records, dedup, incremental, postings, mentions, requests, lifecycle, passes, admin, provenance):
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)

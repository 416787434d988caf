"""All core queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.plans import classification, clustering, fourier, information, language, matrices, rates, spikes

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _module in (information, rates, spikes, language, fourier, classification, matrices, clustering):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

"""reactorlake: a PySpark-native engine for daily capacity-and-outage series.

Layout
------
sources/    landed JSON pages, base tables, snapshots, watermark state,
            and the adapter that derives outage-shaped frames from the test tables
functions/  column expressions (numeric coercion, dates, display labels)
operators/  DataFrame -> DataFrame building blocks (clean, upsert, read, series)
plans/      end-to-end jobs built from operators (refresh, paged reads, comparison)
streaming/  the refresh as a Structured Streaming query

Library code never creates a SparkSession; callers pass one in.
"""

from reactorlake.errors import DataNotFoundError, ProcessingError, ValidationError
from reactorlake.plans.compare import compare_series, latest_series
from reactorlake.plans.refresh import Landing, refresh
from reactorlake.plans.service import FrameCatalog, all_pages, get_dataset, overview
from reactorlake.sources.tables import Warehouse

__all__ = [
    "DataNotFoundError",
    "FrameCatalog",
    "Landing",
    "ProcessingError",
    "ValidationError",
    "Warehouse",
    "all_pages",
    "compare_series",
    "get_dataset",
    "latest_series",
    "overview",
    "refresh",
]

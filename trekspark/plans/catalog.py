"""All queries of the library: importing the operator modules registers them."""

from trekspark.operators import balls, boosting, expressions, filters, forecast, ingest, learned, models, regions, reports, routes, spatial, statistics, tracks, trajectory  # noqa: F401
from trekspark.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

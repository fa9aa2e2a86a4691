from gaugewright.catalog import analysis, fitting, ingest, scans, learning, prep, rating, stream  # noqa: F401
from gaugewright.catalog.base import ORACLES, QUERIES  # noqa: F401

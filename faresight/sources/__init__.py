"""Scans, sources and sinks."""

from faresight.sources.files import *  # noqa: F401,F403
from faresight.sources.airports import airports_df  # noqa: F401

"""Column expressions (no UDFs): time, date, price and text scalars."""

from faresight.functions.timeparts import *  # noqa: F401,F403
from faresight.functions.text import *  # noqa: F401,F403

"""faresight: flight-fare analytics on Spark DataFrames.

Every operator is a function ``DataFrame -> DataFrame`` (or a Column
expression) built on Spark's own expressions, so one definition serves
batch, streaming and prediction.
"""

__version__ = "0.1.0"

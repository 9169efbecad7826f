"""ananas: regional crop reporting on Spark.

Ingest survey, harvest, price, rainfall, soil and pest feeds, normalise place
and farmer names to ids, and answer a fixed family of parameterised reports.
Every report is a function ``(tables, as_of, **params) -> DataFrame`` built
from Spark's own DataFrame operators.
"""

from ananas.sources.tables import Tables

__all__ = ["Tables"]

"""All queries of the engine, by name."""

from voxfield.plans import feeds, personas, records, regions, relational, scalars, similar, sites, streams, synthesis, textual, trends, vectors  # noqa: F401
from voxfield.plans.catalog import ORACLES, QUERIES  # noqa: F401

"""Named queries over the driver tables."""

from tidewatch.plans import decide, forests, ingest, learned, quality, records, runs, shape, streams  # noqa: F401
from tidewatch.plans.catalog import ORACLES, QUERIES  # noqa: F401
from tidewatch.plans import twins  # noqa: E402,F401,I001  after the queries it repeats

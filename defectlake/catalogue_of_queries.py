"""All queries of the library by name, with their SQL."""

from defectlake.plans import authentic, synthetic, validation

QUERIES = {**authentic.QUERIES, **synthetic.QUERIES, **validation.QUERIES}
ORACLES = {**authentic.ORACLES, **synthetic.ORACLES, **validation.ORACLES}

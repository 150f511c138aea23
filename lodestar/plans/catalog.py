"""Every query of the engine, with the SQL that must give the same rows."""

from . import analysis, connect, retrieval

QUERIES = {**retrieval.QUERIES, **analysis.QUERIES, **connect.QUERIES}
ORACLES = {**retrieval.ORACLES, **analysis.ORACLES, **connect.ORACLES}

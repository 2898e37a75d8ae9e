"""Every query of the library by name, and the SQL that gives the same rows."""

from formledger.plans import extraction, flows, pages, records

_MODULES = (records, pages, flows, extraction)
QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}

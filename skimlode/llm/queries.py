"""The queries of the operators in this subpackage, and the SQL of those that SQL can express."""

from . import brown, decontaminate, exactdedup, fim, grammar, jaccard, langid, licences, sharding, suffixes, warc, whitening, wordbpe

_MODULES = (brown, exactdedup, sharding, langid, warc, wordbpe, grammar, jaccard, decontaminate, suffixes, fim, whitening, licences)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}

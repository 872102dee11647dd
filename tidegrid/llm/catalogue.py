"""The queries of this subpackage, and the SQL of those that SQL can express."""

from . import bpe, chat, collocations, decontamination, html_text, lexical, licenses, merkle, neardup, pii, quality, sharding, toxicity

MODULES = [licenses, sharding, neardup, html_text, merkle, decontamination, toxicity, chat, bpe, quality, pii, collocations, lexical]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: f for m in MODULES for k, f in m.ORACLE_SQL.items()}

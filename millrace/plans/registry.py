"""Names of all registered queries, with their SQL."""

from millrace.plans import q_actions, q_chat, q_matching, q_misc, q_search, q_streams

_MODULES = (q_actions, q_matching, q_search, q_chat, q_misc, q_streams)
QUERIES: dict = {name: run for m in _MODULES for name, run in m.QUERIES.items()}
ORACLE: dict = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}

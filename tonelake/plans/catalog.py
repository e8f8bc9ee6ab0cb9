"""All queries of the signal and media operators, with their DuckDB SQL.

Queries over fixtures of a few bytes, whose rows the SQL states, are registered only where none over the tables has their name.
"""

from tonelake.plans import media_queries, signal_queries, stream_queries, table_media, table_text, text_queries

_FIRST = (signal_queries, text_queries, media_queries, stream_queries)
_OVER_TABLES = (table_media, table_text)

QUERIES = {name: of for module in (*_FIRST, *_OVER_TABLES) for name, of in module.QUERIES.items()}
ORACLE_SQL = {name: of for module in (*_FIRST, *_OVER_TABLES) for name, of in module.ORACLE_SQL.items()}

#: Queries over fixtures that aren't registered, for tests: name to query and SQL.
FIXTURES = {name: (of, module.ORACLE_SQL[name]) for module in _FIRST for name, of in module.QUERIES.items() if any(name in m.QUERIES for m in _OVER_TABLES)}

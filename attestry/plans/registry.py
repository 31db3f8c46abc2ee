"""The queries by name, the SQL that must give the same rows, and SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

def query(sql: str | None = None):
    """Registers a function as the query of its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: The bridge's messages in SQL.
MESSAGES = """
    select conv_id as conversation, turn as node, case when turn = 0 then null when turn = 1 then 0 else turn - 2 end as parent,
           turn as position, role, text, '/' || conv_id || '/mapping/' || turn || '/message' as pointer,
           'message:' || sha256('chatgpt:driver' || chr(10) || '/' || conv_id || '/mapping/' || turn || '/message') as record_id
    from conversations"""
#: Parent-first order by a path of positions.
ORDERED = f"""m as ({MESSAGES}),
    walk as (
        select conversation, node, [node] as path from m where parent is null
        union all
        select c.conversation, c.node, list_append(w.path, c.node) from m c join walk w on c.conversation = w.conversation and c.parent = w.node
    ),
    ordered as (select conversation, node, path, row_number() over (partition by conversation order by path) - 1 as ord from walk)"""

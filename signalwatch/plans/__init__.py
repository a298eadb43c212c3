"""Registered queries: each applies operators to given tables; most have the SQL that gives the same rows."""

PLANS = ["signal_queries", "graph_queries", "text_queries", "console_queries", "ledger_queries", "source_queries"]

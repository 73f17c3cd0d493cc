"""Registered queries over the test tables, each beside the SQL it must equal."""

from checks import frame_queries, history_queries, model_queries, text_queries

MODULES = (history_queries, frame_queries, text_queries, model_queries)

"""fieldloom: document field extraction as Spark DataFrame jobs.

Turns a table of document texts ``(doc_key, text)`` into a header table (one
row per document, 30 fields) and an item table (one row per line item, 19
fields) with built-in Spark SQL expressions only.
"""

from fieldloom.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]

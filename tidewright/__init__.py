"""tidewright: statistical analytics over event, signal, vector and text tables on Spark."""

from tidewright.session import checkpointed, get_session, read_table

__all__ = ["checkpointed", "get_session", "read_table"]

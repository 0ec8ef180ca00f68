"""The query catalogue and what runs it."""

"""Incremental forms of the batch ingest steps.

The reference has no streaming operator (no watermarks, windows or state), so
nothing here adds semantics: ``reviews.clean_review_stream`` applies the same
review cleaning (T9) and score parsing (T12) to files as they arrive, with
Structured Streaming's file source, a checkpointed file sink and an
``availableNow`` trigger, so a growing review folder keeps a cleaned copy
without re-reading old files.
"""

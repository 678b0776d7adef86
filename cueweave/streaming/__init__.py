"""Structured Streaming forms of the timeline operators.

Rows of a key are sorted inside each micro-batch. A row older than the newest one already taken
is late: it does not change the timeline and comes out as a ``late`` row instead. A key that
stays silent until the watermark passes its timer is closed.
"""

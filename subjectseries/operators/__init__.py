"""Building blocks over (subject, time) tables.

Every operator that needs order works on ``(subject_id, chunk)`` groups, a chunk
being a fixed span of time, so one busy subject spreads over many tasks. State
that crosses chunks travels in per-chunk summaries, whose number is limited by
the calendar span and not by the number of rows.
"""

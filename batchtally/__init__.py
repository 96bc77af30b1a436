"""Bookkeeping of large file productions as Spark DataFrames.

Chunk plans, ledgers, event counting, log mining, telemetry histograms and
progress rollups. Every operator takes and returns DataFrames; ``now`` is
always a parameter and every order is explicit.
"""

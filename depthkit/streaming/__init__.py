"""Streaming.

The workflow this library reproduces has no streaming operator (no event-time windows,
watermarks or state).  Its row-level cleaning steps are stateless column expressions, so
they apply unchanged to a ``readStream`` DataFrame; that is the only streaming surface
offered.  Depth-window features need whole ordered series and stay batch operators.
"""

from depthkit.streaming.clean import clean_stream  # noqa: F401

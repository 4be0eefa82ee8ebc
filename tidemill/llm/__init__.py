"""Operators of a training-data pipeline.

The package is self-contained: nothing else in the library imports it, and the
modules here import only :mod:`tidemill.llm.common` beside public libraries.
Every operator takes and returns DataFrames; ``queries`` holds the thin
``opN_*`` queries and ``oracles`` their SQL.
"""

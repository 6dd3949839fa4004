"""Operations of a training-data pipeline over documents and pages.

Nothing else in the library imports this subpackage. Every operator takes
DataFrames plus column names and keeps its own output; the registered
``opN_<name>`` queries in :mod:`feedlens.llm.queries` derive their columns
from it.
"""

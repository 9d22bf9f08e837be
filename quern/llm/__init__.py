"""Training-data pipeline operators.

Nothing outside this package imports it.  Every operator module has a general
interface working on DataFrames; :mod:`quern.llm.queries` derives the
registered ``opN_*`` queries from them.
"""

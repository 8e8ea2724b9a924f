"""Operators for preparing training data.

One module per operator.  Each holds the operator with its general interface
and the thin ``opN_*`` query that applies it to the driver's tables.
:mod:`fleetframe.llm.registry` lists the queries and their SQL.
"""

"""Operators of a training-data pipeline over the ``documents`` table.

Nothing outside this folder imports it. Every operator takes a frame with at
least ``doc_id`` and ``text``, selects those two columns first (so extra
columns, whatever their names, cannot interfere) and treats a null text as
empty unless its docstring says otherwise.
"""

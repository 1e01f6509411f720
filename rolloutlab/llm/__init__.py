"""Operators for preparing large text corpora as training data.

Nothing outside this folder (but for the guarded entry module and
``corpus_pipeline.py``) imports it. Each module holds one operator with a
general interface and the thin query ``opN_<name>`` that applies it, with
production parameters, to its whole table.
"""

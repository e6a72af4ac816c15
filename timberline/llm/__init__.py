"""Operators for preparing large text corpora (training data).

Nothing else in :mod:`timberline` imports this subpackage; it may be removed
without touching the point-cloud engine.
"""

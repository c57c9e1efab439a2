"""Estimators for one fit block: numpy on bounded arrays, called by tasks of operators/walkforward.py."""

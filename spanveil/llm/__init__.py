"""Operators of a training-data pipeline; see the module of each for its method and its defined cases."""

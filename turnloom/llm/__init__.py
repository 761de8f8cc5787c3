"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``queries`` and ``oracles`` are
read by the driver's entry module when the subpackage is present.
"""

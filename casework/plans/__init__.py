"""Query plans: the operators applied to the test tables, with their SQL oracles."""

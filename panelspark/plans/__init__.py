"""Composed jobs: panel inputs from the test tables, the panel, the sample, the network."""

"""Argosy: claim-graph analytics and text-table operators on PySpark DataFrames."""

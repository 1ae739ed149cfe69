"""Annotated-matrix analytics on Spark: axis tables, matrices and the plans over them."""

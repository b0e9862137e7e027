"""Order analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame. The reference date is
always an argument (``as_of``), never the clock.
"""

"""Usage analytics for cloud data warehouses as Spark DataFrame jobs.

Every operator is a plain function from DataFrames to a DataFrame. Where the
result depends on "now", the caller passes ``as_of`` so a run can be repeated.
"""

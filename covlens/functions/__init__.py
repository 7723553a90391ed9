"""Members of the model as Spark Columns: dimensions, measures, named filters, filter groups."""

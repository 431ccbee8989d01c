"""Document and entity analytics on Spark: sources, Column functions, operators, query plans and streams."""

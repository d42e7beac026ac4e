"""bytesmith: binary-structure analytics on Spark DataFrames."""

"""arborel: point-cloud analytics and tree mapping on Spark DataFrames."""

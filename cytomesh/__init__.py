"""cytomesh: microscopy field analytics and corpus operators on Spark DataFrames."""

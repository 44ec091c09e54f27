"""Index-shaped analytics on Spark DataFrames: maps, sequences, queues, boxes, runs, logs."""

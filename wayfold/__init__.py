"""Route analytics over tiled worlds, and training-data operators, on Spark."""

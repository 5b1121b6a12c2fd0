"""colloquy: corpus-scale meeting-text analytics on Spark DataFrames."""

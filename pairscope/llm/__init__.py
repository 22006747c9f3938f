"""Training-data operators: ten large-scale text, vector and archive jobs."""

"""Sampling, pairing, neighbourhoods, pooling and the three metrics."""

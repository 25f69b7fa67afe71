"""Live scores and the stateful temporal filter."""

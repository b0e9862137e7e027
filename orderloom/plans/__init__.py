"""End-to-end analyses out of the operators."""

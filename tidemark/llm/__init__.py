"""Training-data operators. Nothing outside this subpackage imports it; queries.py registers them."""

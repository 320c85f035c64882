"""Readers of landed files and the writers next to them."""

"""Operators of a training-data pipeline over the shared tables; nothing else in the library imports them."""

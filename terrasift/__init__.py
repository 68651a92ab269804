"""Listing analytics on Spark: semi-structured property listings as relations, and what is asked of them."""

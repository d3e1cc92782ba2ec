"""Sensitive-span analytics on Spark: find, resolve, replace, rewrite and score sensitive spans in many documents."""

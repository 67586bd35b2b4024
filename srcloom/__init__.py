"""Spark jobs over bodies of source text: metrics, rules, duplicates, cross references and findings."""

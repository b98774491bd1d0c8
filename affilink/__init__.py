"""Affiliation entity linking and corpus preparation as Spark plans."""

"""Rated-competition analytics expressed as Spark DataFrame plans."""

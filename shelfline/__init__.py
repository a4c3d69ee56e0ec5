"""Curation of product web-page datasets as Spark DataFrame jobs."""

"""Opportunity discovery on Spark: extract, classify, de-duplicate, diff and announce career postings."""

"""Judging and analysing structured records with Spark."""

"""Readers that turn files and tables into the long-form clustering model."""

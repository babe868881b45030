"""Loaders: files, pages and tables to documents."""

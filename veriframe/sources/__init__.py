"""Readers and compilers that make fact tables out of pages, catalogs, queries and source files."""

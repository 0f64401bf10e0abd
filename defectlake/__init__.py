"""Spark jobs that measure code defects over very large tables of Python submissions."""

"""Literal-pattern redaction of text tables and ordered chunk streams on Spark."""

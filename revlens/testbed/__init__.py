"""Binding of the shared test tables to raw invoice lines, with the queries and their SQL oracle."""

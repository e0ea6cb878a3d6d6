"""Queries over the test tables, by topic, with the SQL they must agree with where SQL can state them."""

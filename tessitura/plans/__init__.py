"""Views over the provided tables and the queries built from the operators."""

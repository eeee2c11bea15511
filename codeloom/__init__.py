"""Code-structure analytics on Spark: files, symbols, imports and calls as tables; graphs as joins."""

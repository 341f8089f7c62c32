"""The query catalogue: one registered query per operator, each with a SQL twin where SQL can express it."""

"""The driver's tables seen as charging tables, with queries and their SQL counterparts."""

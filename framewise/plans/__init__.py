"""Registered queries: the operators bound to the driver's tables, with DuckDB SQL for each where SQL can say it."""

"""Operators put together: the engine, its traces and server, and the queries over the tables."""

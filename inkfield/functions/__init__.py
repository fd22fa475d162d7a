"""Scalar functions, Column to Column. All run inside the JVM."""

"""Column expressions.  Everything here maps Column to Column and stays inside the JVM."""

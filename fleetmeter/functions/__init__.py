"""Column expressions shared by the operators. All run inside Catalyst; none is a Python UDF."""

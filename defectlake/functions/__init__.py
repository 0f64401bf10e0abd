"""Column expressions and the one helper that has to read Python source."""

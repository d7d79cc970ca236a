"""Panel operators, each DataFrame -> DataFrame with column roles as parameters."""

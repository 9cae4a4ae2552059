"""Column functions: Column in, Column out, nothing that needs a DataFrame."""

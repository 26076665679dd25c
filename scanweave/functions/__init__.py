"""Column functions: rounding, units, crystallography, optics."""

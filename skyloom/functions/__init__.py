"""Column functions: parsing, units, calendar, geodesy, grid cells."""

"""Column functions: text, arrays, geometry and schedules, hashing. All are built-in expressions; none calls Python per row."""

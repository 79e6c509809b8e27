"""Column expressions (no UDFs): locale number/date parsing, calendar maths."""

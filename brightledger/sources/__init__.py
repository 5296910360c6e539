"""Reading documents and tables, writing CSV, JSON and keyed tables."""

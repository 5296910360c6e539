"""The registered queries: every operator over the supplied tables, with DuckDB SQL to hold it against."""

"""Column functions: labels and text, disclosed numbers, reporting periods. No Python runs on rows."""

"""Reading and writing: JSON lines, raw and graph tables, role views."""

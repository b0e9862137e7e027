"""Reading logical tables and writing reports."""

"""Files and reports."""

"""A PySpark library that finds, masks, pseudonymizes and audits sensitive data in tables."""

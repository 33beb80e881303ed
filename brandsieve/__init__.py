"""Brand-impersonation and abuse-domain analytics as PySpark DataFrame jobs."""

"""proofline: corpus-scale document, record and version audits as Spark DataFrame jobs."""

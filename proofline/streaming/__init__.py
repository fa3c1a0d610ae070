"""proofline streaming."""

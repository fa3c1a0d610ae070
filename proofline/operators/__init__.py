"""proofline operators."""

"""proofline functions."""

"""proofline sources."""

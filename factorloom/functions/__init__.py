"""Part of factorloom."""

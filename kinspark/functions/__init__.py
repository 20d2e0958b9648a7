"""Part of kinspark; see README.md."""

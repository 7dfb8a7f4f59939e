"""Part of groundlake; see README.md."""

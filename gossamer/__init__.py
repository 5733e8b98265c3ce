"""Part of gossamer."""

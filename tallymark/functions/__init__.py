"""Part of tallymark."""

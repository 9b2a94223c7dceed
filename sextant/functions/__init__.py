"""Part of the sextant engine."""

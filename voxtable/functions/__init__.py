"""Part of voxtable."""

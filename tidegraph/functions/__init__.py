"""Part of tidegraph."""

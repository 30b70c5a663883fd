"""Part of lexigraph."""

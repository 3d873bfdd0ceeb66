"""Rules kept as data: formats, field specs, attack patterns and dimension tables."""

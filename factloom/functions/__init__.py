"""See the package docstring and README for what lives here."""

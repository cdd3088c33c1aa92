"""Part of karst; see the README for what lives here."""

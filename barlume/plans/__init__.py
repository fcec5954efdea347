"""Bar specifications and the catalogue of registered queries."""

"""Stage functions, domain runs and the catalogue of registered queries."""

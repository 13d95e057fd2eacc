"""Views over the driver's tables, and the catalogue of registered queries."""

"""Column-level helpers: label taxonomies and scalar text expressions."""

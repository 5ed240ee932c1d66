"""Extension: tables and index kept up to date from a stream."""

"""Extension: scoring streams against fixed centers."""

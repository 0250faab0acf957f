"""Reading landed collection bodies and writing immutable runs."""

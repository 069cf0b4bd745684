"""Relations that documents come from: repository trees."""

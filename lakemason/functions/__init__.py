"""Part of lakemason; see the README for the map of modules."""

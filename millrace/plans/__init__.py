"""From query text to a resolved, normalised plan."""

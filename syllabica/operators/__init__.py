"""DataFrame-to-DataFrame jobs. Nothing here collects or triggers an action."""

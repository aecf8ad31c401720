"""Named queries: cleaning, exploration, features, scoring, roll-ups."""

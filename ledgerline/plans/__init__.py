"""Named operations: their contracts and how they are carried out."""

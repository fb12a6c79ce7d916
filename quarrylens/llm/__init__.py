"""Operators for training data: documentation pairs, neighbours, survivors, encoding, mixing and page residue."""

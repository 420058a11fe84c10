"""Operators for text collections: sizing, packing, mixing and residue detection."""

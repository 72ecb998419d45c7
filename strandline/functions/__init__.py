"""Column functions: coordinates, CIGAR, flags, sequences, attributes."""

"""Column functions: alleles, statistics, quality, display."""

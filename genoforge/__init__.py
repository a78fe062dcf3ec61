"""Spark-native analytics for variant, genotype, phenotype and interval data."""

"""Allele-profile, tree and corpus analytics as Spark plans."""

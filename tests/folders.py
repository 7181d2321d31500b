"""Folders of the given tables."""
SMALL = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"

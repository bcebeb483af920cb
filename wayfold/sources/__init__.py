"""Readers: source tables of tiles and teleports, region blobs, text files."""

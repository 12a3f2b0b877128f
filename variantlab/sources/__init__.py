"""Readers and writers of the file formats that samples, sequences and profiles come in."""

"""Readers and writers of the file formats around token corpora."""

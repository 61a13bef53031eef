"""Numpy routines on single images; operators run them on Arrow batches."""

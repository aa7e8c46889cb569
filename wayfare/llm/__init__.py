"""Operators for preparing large text corpora, all over plain DataFrames."""

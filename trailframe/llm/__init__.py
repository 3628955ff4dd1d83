"""Operators for preparing large text corpora, each written as Spark jobs.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; `registry` lists the thin queries that apply them to whole tables.
"""

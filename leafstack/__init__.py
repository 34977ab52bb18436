"""leafstack: catalogues of saved web pages as Spark tables.

A catalogue is a handful of DataFrames (items, ordered tree edges, extracted
text, files).  Every capability is a DataFrame -> DataFrame function; see the
README for the module map.
"""

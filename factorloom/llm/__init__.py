"""Training-data operators (numbered 1 to 13) over a table of documents.

Nothing else in the library imports this subpackage. ``registry`` holds the queries and their SQL.
"""

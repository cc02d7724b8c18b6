"""tagloom: namespaced tag graphs over large file collections, on Spark DataFrames."""

"""glyphmill: document-evidence analytics over PySpark DataFrames."""

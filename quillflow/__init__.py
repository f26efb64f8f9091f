"""quillflow: document-collection processing on Spark DataFrames."""

"""clauseframe: raw web documents to structured, labelled passages, as Spark DataFrames."""

"""corpusloom: building and mining document corpora with DataFrames."""

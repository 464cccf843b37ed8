"""siltworks: data curation and analytics over Spark DataFrames."""

"""Set-at-a-time skill matching, availability analytics and audit on Spark DataFrames."""

"""lexispark: comparative-wordlist analytics on Spark DataFrames."""

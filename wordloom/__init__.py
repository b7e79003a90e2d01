"""wordloom: word division, lexicon review and text-corpus operators on PySpark."""

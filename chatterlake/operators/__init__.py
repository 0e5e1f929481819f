"""Set-based operators over all keys at once; every function takes and gives DataFrames."""

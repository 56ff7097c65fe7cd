"""Steps of the triage query on DataFrames."""

"""logspark: session analytics over event logs, written as plain Spark plans.

Every operator takes DataFrames and returns a DataFrame. Nothing is pulled to the driver except
objects whose size is fixed by the event vocabulary, the model or the number of input splits.
"""

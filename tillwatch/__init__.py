"""Fleet availability analytics on Spark DataFrames.

The package turns raw machine tables (transactions, status logs, balance
readings, service records, machine master) into one row per machine and day,
derives features from that, scores the fleet and answers the operating
questions on top of it.
"""

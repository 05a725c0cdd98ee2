"""Whole flows composed of operators: cleaning, overview, insights, anomaly runs, joins."""
